"""Chat formatting by a template compiler.

``compile_template`` parses a small sandboxed language into a syntax tree, folds
constants, and builds Python closures. Rendering is a generator: it takes messages
one by one and gives pieces with a flag for text the model is trained on, so a
conversation of any length is formatted in bounded memory.

    {{ expr }}   {% for m in messages %} .. {% endfor %}   {% generation %} .. {% endgeneration %}
    {% if e %} .. {% elif e %} .. {% else %} .. {% endif %}

Expressions: literals, names, ``a.b`` and ``a['b']`` on message fields, ``loop.index0``,
``loop.index``, ``loop.first``, ``== != in not and or ~``, and filters from a fixed table.
There are no calls, no attributes of Python objects, and no names but the given ones.

Control strings inside texts are escaped: a backslash is doubled, and one is put after
the ``<`` of anything that looks like a turn mark. ``unescaped`` undoes it exactly.

Edge cases: a null role or text is empty; rows of equal turn follow role and text, null turns
come first; rows without conv_id form one conversation; repeated rows are turns of their
own; an empty table gives an empty one; extra columns are left out. ``compile_template`` loops
over a list as often as the template says; ``formatted`` streams turns and refuses a template that
reads ``messages`` more than once. A conversation's digest is sequential by definition, so its turns pass through one task as
a stream, sorted on disk by Spark, never held together.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, fields, is_dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pannier.session import materialise

OPEN, CLOSE = "<turn ", "</turn>"
TEMPLATE = (
    "{% for m in messages %}<turn {{ m.role|name }}>\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text|escape }}{% endgeneration %}"
    "{% else %}{{ m.text|escape }}{% endif %}</turn>\n{% endfor %}"
)
#: Output rows are closed at about this many characters.
CHUNK = 1 << 16


def escaped(text: str) -> str:
    text = text.replace("\\", "\\\\")
    return text.replace(OPEN, "<\\" + OPEN[1:]).replace(CLOSE, "<\\" + CLOSE[1:])


def escaped_name(text: str) -> str:
    """For the head of a turn, which ends at an unescaped ``>``."""
    return escaped(text).replace(">", "\\>")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda v: escaped(_text(v)),
    "name": lambda v: escaped_name(_text(v)),
    "trim": lambda v: _text(v).strip(),
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "length": lambda v: len(_text(v)),
}


class TemplateError(ValueError):
    pass


def _text(value: Any) -> str:
    return "" if value is None else str(value)


# ---- syntax tree -------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    base: Any
    key: str


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    arg: Any
    name: str


@dataclass(frozen=True)
class Show:
    expr: Any


@dataclass(frozen=True)
class If:
    cases: tuple  # of (condition, body)


@dataclass(frozen=True)
class For:
    var: str
    source: str
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|[.\[\]()|~]))")


def _lex(source: str) -> list[tuple[str, str]]:
    out, at, source = [], 0, source.strip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:]!r}")
        kind = ("int", "str", "name", "op")[m.lastindex - 1]
        out.append((kind, m.group(m.lastindex)))
        at = m.end()
    return out


class _Expr:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens, self.at = _lex(source), 0

    def _peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else None

    def _take(self, *wanted: str) -> str | None:
        if self._peek() in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def _need(self, wanted: str) -> None:
        if not self._take(wanted):
            raise TemplateError(f"{wanted!r} expected")

    def whole(self):
        out = self._or()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def _chain(self, below, *ops: str):
        left = below()
        while op := self._take(*ops):
            left = Op(op, (left, below()))
        return left

    def _or(self):
        return self._chain(self._and, "or")

    def _and(self):
        return self._chain(self._not, "and")

    def _not(self):
        return Op("not", (self._not(),)) if self._take("not") else self._chain(self._join, "==", "!=", "in")

    def _join(self):
        return self._chain(self._post, "~")

    def _post(self):
        node = self._atom()
        while True:
            if self._take("."):
                node = Field(node, self._word())
            elif self._take("["):
                kind, key = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
                if kind != "str":
                    raise TemplateError("a quoted field name expected")
                self.at += 1
                node = Field(node, _literal(key))
                self._need("]")
            elif self._take("|"):
                name = self._word()
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                node = Filter(node, name)
            else:
                return node

    def _word(self) -> str:
        kind, word = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind != "name":
            raise TemplateError("a name expected")
        self.at += 1
        return word

    def _atom(self):
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends early")
        kind, word = self.tokens[self.at]
        self.at += 1
        if kind == "int":
            return Const(int(word))
        if kind == "str":
            return Const(_literal(word))
        if kind == "name":
            fixed = {"true": True, "false": False, "none": None}
            return Const(fixed[word]) if word in fixed else Name(word)
        if word == "(":
            node = self._or()
            self._need(")")
            return node
        raise TemplateError(f"unexpected {word!r}")


def _literal(quoted: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), quoted[1:-1], flags=re.S)


def parse(source: str) -> tuple:
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", source, flags=re.S)
    tags = iter([p for p in parts if p])
    body, end = _block(tags, ())
    assert end is None
    return body


def _block(tags: Iterator[str], ends: tuple[str, ...]) -> tuple[tuple, str | None]:
    """Nodes up to one of the closing words, and the closing tag's text."""
    out: list = []
    for part in tags:
        if part.startswith("{{"):
            out.append(Show(_Expr(part[2:-2]).whole()))
        elif not part.startswith("{%"):
            out.append(Show(Const(part)))
        else:
            tag = part[2:-2].strip()
            word, _, rest = tag.partition(" ")
            if word in ends:
                return tuple(out), tag
            if word == "generation":
                out.append(Generation(_block(tags, ("endgeneration",))[0]))
            elif word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+([A-Za-z_]\w*)", rest.strip())
                if not m:
                    raise TemplateError(f"cannot read {tag!r}")
                out.append(For(m[1], m[2], _block(tags, ("endfor",))[0]))
            elif word == "if":
                cases, condition = [], _Expr(rest).whole()
                while True:
                    body, end = _block(tags, ("elif", "else", "endif"))
                    cases.append((condition, body))
                    if end == "endif":
                        break
                    condition = Const(True) if end == "else" else _Expr(end.partition(" ")[2]).whole()
                out.append(If(tuple(cases)))
            else:
                raise TemplateError(f"unknown tag {tag!r}")
    if ends:
        raise TemplateError(f"{' or '.join(ends)} is missing")
    return tuple(out), None


# ---- constant folding ----------------------------------------------------------------

_OPS: dict[str, Callable[..., Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "in": lambda a, b: _text(a) in _text(b),
    "~": lambda a, b: _text(a) + _text(b),
    "not": lambda a: not a,
}


def fold(node):
    """The same tree with everything that needs no message worked out."""
    if isinstance(node, tuple):
        return _merged([fold(n) for n in node])
    if isinstance(node, Filter):
        arg = fold(node.arg)
        return Const(FILTERS[node.name](arg.value)) if isinstance(arg, Const) else Filter(arg, node.name)
    if isinstance(node, Field):
        return Field(fold(node.base), node.key)
    if isinstance(node, Op):
        args = tuple(fold(a) for a in node.args)
        if node.op in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
        if node.op in _OPS and all(isinstance(a, Const) for a in args):
            return Const(_OPS[node.op](*[a.value for a in args]))
        return Op(node.op, args)
    if isinstance(node, Show):
        return Show(fold(node.expr))
    if isinstance(node, For):
        return For(node.var, node.source, fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        cases = []
        for condition, body in node.cases:
            condition = fold(condition)
            if isinstance(condition, Const) and not condition.value:
                continue
            cases.append((condition, fold(body)))
            if isinstance(condition, Const):
                break
        return If(tuple(cases))
    return node


def _merged(nodes: list) -> tuple:
    """Decided branches spliced in, neighbouring constants joined, empty ones gone."""
    flat: list = []
    for n in nodes:
        decided = isinstance(n, If) and (not n.cases or isinstance(n.cases[0][0], Const))
        flat.extend((n.cases[0][1] if n.cases else ()) if decided else [n])
    out: list = []
    for n in flat:
        if isinstance(n, Show) and isinstance(n.expr, Const):
            text = _text(n.expr.value)
            if out and isinstance(out[-1], Show) and isinstance(out[-1].expr, Const):
                text = out.pop().expr.value + text
            if not text:
                continue
            n = Show(Const(text))
        out.append(n)
    return tuple(out)


# ---- closures ------------------------------------------------------------------------


def _value(node) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, n=node.name: env.get(n)
    if isinstance(node, Field):
        base = _value(node.base)

        def field(env: dict, base=base, key=node.key):
            owner = base(env)
            return owner.get(key) if isinstance(owner, dict) else None

        return field
    if isinstance(node, Filter):
        arg, function = _value(node.arg), FILTERS[node.name]
        return lambda env: function(arg(env))
    args = [_value(a) for a in node.args]
    if node.op == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.op == "or":
        return lambda env: args[0](env) or args[1](env)
    function = _OPS[node.op]
    return lambda env: function(*[a(env) for a in args])


def _body(nodes: tuple) -> Callable[[dict, bool], Iterator[tuple[str, bool]]]:
    steps = [_step(n) for n in nodes]

    def run(env: dict, learn: bool) -> Iterator[tuple[str, bool]]:
        for step in steps:
            yield from step(env, learn)

    return run


def _step(node):
    if isinstance(node, Show):
        value = _value(node.expr)

        def show(env, learn):
            text = _text(value(env))
            if text:
                yield text, learn

        return show
    if isinstance(node, Generation):
        body = _body(node.body)
        return lambda env, learn: body(env, True)
    if isinstance(node, If):
        cases = [(_value(c), _body(b)) for c, b in node.cases]

        def branch(env, learn):
            for condition, body in cases:
                if condition(env):
                    yield from body(env, learn)
                    return

        return branch
    body = _body(node.body)

    def loop(env, learn):
        source = env.get(node.source)
        if isinstance(source, (str, dict)) or not isinstance(source, Iterable):
            raise TemplateError(f"{node.source} is not a list")
        for i, item in enumerate(source):
            own = {**env, node.var: item, "loop": {"index0": i, "index": i + 1, "first": i == 0}}
            yield from body(own, learn)

    return loop


def compile_template(source: str) -> Callable[[Iterable[dict]], Iterator[tuple[str, bool]]]:
    """Closure from messages (dicts, possibly a stream) to pieces (text, trained on)."""
    body = _body(fold(parse(source)))
    return lambda messages, **more: body({**more, "messages": messages}, False)


def _readings(node) -> int:
    """How often a rendering may go through ``messages``; a use outside of a loop's head counts as two."""
    if isinstance(node, tuple):
        return sum(map(_readings, node))
    if isinstance(node, If):
        conditions, bodies = zip(*node.cases) if node.cases else ((), ())
        return _readings(conditions) + max(map(_readings, bodies), default=0)
    if isinstance(node, For):
        return (node.source == "messages") + 2 * _readings(node.body)
    if isinstance(node, Name):
        return 2 * (node.name == "messages")
    return sum(_readings(getattr(node, f.name)) for f in fields(node)) if is_dataclass(node) else 0


# ---- Spark ---------------------------------------------------------------------------


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def formatted(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Format ``turns(conv_id, turn, role, text)``.

    Rows (conv_id, seq, text, masks): a conversation's output in order of ``seq``,
    ``masks`` the (start, end) of trained text inside ``text``, in code points.
    """
    compile_template(template)  # a faulty template fails here, not in tasks
    if _readings(fold(parse(template))) > 1:
        raise TemplateError("turns are streamed: a template can loop over messages once")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        for conv, rows in itertools.groupby(_rows(batches), key=lambda r: r[0]):
            messages = ({"role": _text(r[1]), "text": _text(r[2])} for r in rows)
            parts, masks, size, seq = [], [], 0, 0
            for piece, learn in render(messages):
                if learn:
                    masks.append({"start": size, "end": size + len(piece)})
                parts.append(piece)
                size += len(piece)
                if size >= CHUNK:
                    yield _piece(conv, seq, parts, masks)
                    parts, masks, size, seq = [], [], 0, seq + 1
            yield _piece(conv, seq, parts, masks)

    ordered = (
        turns.select(F.col("conv_id").cast("long"), "turn", "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
    )
    return ordered.mapInArrow(run, "conv_id long, seq long, text string, masks array<struct<start: long, end: long>>")


_MASKS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _piece(conv, seq, parts, masks) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([conv], pa.int64()), pa.array([seq], pa.int64()), pa.array(["".join(parts)]), pa.array([masks], _MASKS)],
        ["conv_id", "seq", "text", "masks"],
    )


_TURN = re.compile(r"<turn ((?:[^\\>]|\\.)*)>\n", re.S)


def read_back(pieces: DataFrame) -> DataFrame:
    """Parse formatted conversations again, piece after piece.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, rows in itertools.groupby(_rows(batches), key=lambda r: r[0]):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n_turns = loss_chars = size = 0
            rest = ""
            for _, text, masks in rows:
                size += len(text)
                for m in masks:
                    learned = unescaped(text[m["start"] : m["end"]])
                    loss_chars += len(learned)
                    loss.update(learned.encode())
                rest, at = rest + text, 0
                while True:
                    head = _TURN.match(rest, at)
                    end = rest.find(CLOSE + "\n", head.end()) if head else -1
                    if end < 0:
                        break
                    turns.update(f"{unescaped(head[1])}\n{unescaped(rest[head.end() : end])}\n".encode())
                    n_turns += 1
                    at = end + len(CLOSE) + 1
                rest = rest[at:]
            if rest:
                raise ValueError(f"conversation {conv} ends inside a turn")
            out.append((conv, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), size))
            if len(out) >= 1000:
                yield _digests(out)
                out = []
        if out:
            yield _digests(out)

    ordered = (
        pieces.select("conv_id", "seq", "text", "masks")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "seq")
        .select("conv_id", "text", "masks")
    )
    return ordered.mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def written(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """The formatted pieces as a stored table."""
    return materialise(formatted(turns, template), "formatted")
