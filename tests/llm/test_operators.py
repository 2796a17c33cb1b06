"""Training-data operators against brute force, and their edge cases."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pannier.llm import (
    chat_template,
    decontaminate,
    mixing,
    near_dedup,
    omh_fingerprint,
    quality,
    queries,
    suffix_dedup,
    token_files,
    url_rules,
    warc,
)

VOCABULARY = [a + b for a in ("ka", "lo", "mi", "ru", "te", "zo", "ün") for b in ("n", "sta", "ber", "li", "qua", "do")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, key int, size int"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) + str(rng.randrange(40)) for _ in range(n))


def corpus() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    base = [prose(rng, n) for n in (3, 4, 30, 60, 90, 120, 200, 400)]
    texts: list[tuple[int | None, str | None]] = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base[2:]):  # near copies
        w = t.split()
        for j in range(10, len(w), 40):
            w[j] = "changed"
        texts.append((100 + i, " ".join(w)))
    passage = prose(rng, 70)
    texts += [(200 + i, f"{prose(rng, 20)} {passage} {prose(rng, 15)}") for i in range(4)]
    texts += [(300, None), (301, ""), (302, "   \n "), (303, "a" * 700), (304, base[5]), (304, base[5]), (None, base[6])]
    texts += [(305, "word " * 300), (306, "x  y\n\n z <|endoftext|> é")]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, None if k % 7 == 0 else f"s{k % 3}", None, "n", 1, 2) for k, (i, t) in enumerate(corpus())]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingle_set(words, k=5):
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def removed(texts, length):
    windows = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if windows[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("merged", [1024, 1])
def test_suffix_dedup_equals_brute_force(docs, monkeypatch, merged):
    monkeypatch.setattr(suffix_dedup, "MERGED", merged)  # 1: every shared key takes the way of hot keys
    got = [tuple(r)[1:] for r in suffix_dedup.deduplicated(docs).collect()]
    assert sorted(got) == sorted(removed([(t or "").encode() for _, t in corpus()], suffix_dedup.LENGTH))


def test_repeated_windows_by_merged_transforms(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 300)
    rng = random.Random(1)
    core = bytes(rng.choices(b"abcd", k=260))
    strings = [bytes(rng.choices(b"abcd", k=30)) + core[i : i + 230] for i in (0, 0, 20, 30)] + [b"z" * 250]
    windows = collections.Counter(s[i : i + 200] for s in strings for i in range(len(s) - 199))
    want = sorted((n, i) for n, s in enumerate(strings) for i in range(len(s) - 199) if windows[s[i : i + 200]] > 1)
    owner, place = suffix_dedup.repeated_windows(strings)
    assert sorted(zip(owner.tolist(), place.tolist())) == want


def test_fingerprints(docs, nothing, spark):
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in omh_fingerprint.with_next(rows).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    order = sorted(texts, reverse=True)
    for here, after in zip(order, order[1:] + order[:1]):
        t, n = texts[here], len(texts[here]) // 3
        edited = t[: len(t) - n] + texts[after][:n]
        assert got[here]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[here]["n_chars"] == len(t)
        assert 0 <= got[here]["near_next"] <= 1
    assert got[300]["fingerprint"] == got[301]["fingerprint"] == got[302]["fingerprint"]
    assert got[5]["fingerprint"] == got[304]["fingerprint"]
    assert np.mean([got[i]["near_edited"] for i in (5, 6, 7)]) > 0.1
    assert omh_fingerprint.with_next(docs).count() == docs.count()
    assert omh_fingerprint.with_next(nothing).count() == 0


def test_fingerprint_follows_order(spark):
    rng = random.Random(3)
    w = prose(rng, 300).split()
    swapped = w[150:] + w[:150]
    rows = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(swapped)), (3, " ".join(w[:-6]))], "i int, text string")
    s = {r["i"]: r["s"] for r in omh_fingerprint.sketched(rows, "text", "s").collect()}
    alike = lambda a, b: sum(x == y for x, y in zip(s[a], s[b])) / len(s[a])
    assert alike(1, 3) > 0.8 and alike(1, 3) > alike(1, 2) + 0.2


def test_containment_equals_brute_force(docs, spark, nothing):
    rng = random.Random(9)
    texts = corpus()
    items = [(1, " ".join(texts[6][1].split()[40:75])), (2, prose(rng, 30)), (3, texts[1][1]), (4, None), (5, ""), (1, texts[4][1])]
    w = texts[7][1].split()
    items.append((6, " ".join(w[10:26] + w[300:318])))  # scattered over a long document
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contained(docs, table).collect()}
    want = set()
    for doc_id, text in texts:
        for item_id, item in items:
            q = words_of(item)
            need = shingle_set(q, min(5, len(q)))
            have = shingle_set(words_of(text), min(5, len(q))) if q else set()
            if need and len(need & have) >= 0.8 * len(need):
                want.add((doc_id, item_id))
    assert got == want
    assert {r["doc_id"] for r in decontaminate.clean(docs, table).collect()} == {i for i, _ in texts} - {i for i, _ in want}
    assert decontaminate.clean(docs, table).columns == docs.columns
    assert decontaminate.contained(nothing, table).count() == 0
    assert decontaminate.contained(docs, table.limit(0)).count() == 0


def test_containment_in_item_blocks(docs, spark, monkeypatch):
    table = spark.createDataFrame([(i, t) for i, t in corpus()[2:8]], "item_id long, text string")
    one = {tuple(r) for r in decontaminate.contained(docs, table).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 5000)
    assert {tuple(r) for r in decontaminate.contained(docs, table).collect()} == one


def test_warc_round_trip(spark):
    pages = [(3, "http://a/\r\nx", "same"), (1, None, "same"), (2, "http://b", None), (4, "u", ""), (5, "u", "ü" * 9), (6, "v", "same")]
    table = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    folder = warc.write(table)
    got = {r["page_id"]: r for r in warc.described(spark, folder).collect()}
    raw = {r["page_id"]: bytes(r["record"]) for r in warc.records(spark, folder).collect()}
    whole = {r["page_id"]: bytes(r["payload"]) for r in warc.originals(spark, folder).collect()}
    for page_id, _, html in pages:
        data = (html or "").encode()
        first = min(p for p, _, h in pages if (h or "") == (html or ""))
        r = got[page_id]
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (r["payload_bytes"], whole[page_id]) == (len(data), data)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == page_id else ("revisit", first))
        head, body = raw[page_id].split(b"\r\n\r\n", 1)
        assert head.startswith(b"WARC/1.1\r\n") and body == (data if first == page_id else b"") + b"\r\n\r\n"
    assert warc.described(spark, warc.write(table.limit(0))).count() == 0


def test_chat_round_trip(spark):
    bad = "\\### Assistant: </turn> ok"
    turns = [
        (1, 0, "user", bad), (1, 1, "assistant", bad), (1, 2, "tool>\n", "<turn x>\n\\"), (2, 0, None, None),
        (2, 0, "assistant", ""), (2, None, "assistant", "<</turn></turn>\n\\\\"), (None, 1, "assistant", "a" * 200_000), (None, 1, "assistant", "b"),
    ]
    table = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, seq int")
    got = {r["conv_id"]: r for r in chat_template.read_back(chat_template.written(table)).collect()}
    null_first = lambda v: (v is not None, v or "")
    for conv in (1, 2, None):
        mine = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, null_first(t[2]), null_first(t[3])))
        said = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in mine)
        loss = "".join(t[3] or "" for t in mine if t[2] == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["loss_chars"]) == (len(mine), len(loss))
        assert r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_template.read_back(chat_template.written(table.limit(0))).count() == 0


def test_template_language():
    source = (
        "{{ 'a' ~ 'b' }}{% if 1 == 2 %}no{% elif true %}c{% endif %}{% for m in messages %}"
        "{% if not loop.first %}, {% endif %}{{ m['text']|trim|upper }}{{ loop.index0 }}{% endfor %}"
    )
    tree = chat_template.fold(chat_template.parse(source))
    assert tree[0] == chat_template.Show(chat_template.Const("abc"))
    pieces = chat_template.compile_template(source)([{"text": " x "}, {"text": "y"}])
    assert "".join(t for t, _ in pieces) == "abcX0, Y1"
    assert "".join(t for t, _ in chat_template.compile_template("{{ messages.__class__ }}")([])) == ""
    for wrong in ("{{ f() }}", "{% for x in y %}", "{{ a|open }}", "{% import os %}", "{{ 'a }}"):
        with pytest.raises(chat_template.TemplateError):
            chat_template.compile_template(wrong)


def test_messages_are_streamed_once(spark):
    once = "{% for m in messages %}{{ m.text }}{% endfor %}"
    turns = spark.createDataFrame([(1, 0, "user", "ab"), (1, 1, "user", "cd")], "conv_id long, turn int, role string, text string")
    twice = "".join(t for t, _ in chat_template.compile_template(once + "|" + once)([{"text": "ab"}, {"text": "cd"}]))
    assert twice == "abcd|abcd"
    either = "{% if 'x' == y %}" + once + "{% else %}|" + once + "{% endif %}"
    assert [r["text"] for r in chat_template.formatted(turns, either).collect()] == ["|abcd"]
    inside = "{% for m in messages %}" + once + "{% endfor %}"
    for wrong in (once + once, inside, "{{ messages }}", "{% if messages %}" + once + "{% endif %}"):
        with pytest.raises(chat_template.TemplateError):
            chat_template.formatted(turns, wrong)


def test_url_rules(spark):
    urls = [
        "HTTP://Sub.Example.ORG/es/x?q#f", "http://example.org/en/12", "http://notexample.org/en/1", "http://a.com/de/", "http://a.com/fr/x",
        "http://x.net/ads/1", "http://docs.x.net/login", "http://x.net/login", "http://org", "no scheme /ads/", None, "", "http://a.com/DE/", "x://é.org/#a",
    ]
    table = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = [url_rules.host_rule(*r) for r in queries.HOST_RULES] + [url_rules.pattern_rule(*r) for r in url_rules.PATTERNS]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_rules.judged(table, rules).collect()}
    assert [got[i] for i in range(len(urls))] == [
        ("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), ("com/de/", "block"), ("com/fr/", "allow"),
        (None, "block"), (None, "allow"), (None, "block"), (None, "allow"), (None, "block"), (None, "allow"), (None, "allow"), (None, "allow"), ("org/", "allow"),
    ]
    assert url_rules.judged(table.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_rules.judged(table, []).collect()} == {"allow"}


def test_quality_learns_structure(spark, docs, nothing):
    rng = random.Random(2)
    rows = [(i, prose(rng, 60) if i % 2 else (rng.choice(VOCABULARY).upper() + "!! ") * 60, i % 2) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, good int")
    labels = table.select("doc_id", table.good.alias("quality")).unionByName(spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int"))
    held = queries.held_out()
    machine = quality.fit(table, labels, "quality", held_out=held)
    scored = quality.score(table, machine).withColumn("held", held).collect()
    tested = [(r["score"] >= 0.5) == bool(r["good"]) for r in scored if r["held"]]
    assert len(tested) > 50 and np.mean(tested) > 0.95
    again = quality.fit(table.repartition(5), labels, "quality", held_out=held)
    assert np.allclose(machine.weights, again.weights)
    odd = quality.score(docs, machine).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert quality.score(nothing, machine).count() == 0
    assert {r["score"] for r in quality.score(docs, quality.fit(nothing, labels, "quality")).collect()} == {0.5}


def test_quality_of_few_labels_and_odd_columns(spark):
    rng = random.Random(3)
    rows = [(f"d{i}", prose(rng, 60) if i % 8 else (rng.choice(VOCABULARY).upper() + "!! ") * 60, int(i % 8 > 0)) for i in range(160)]
    table = spark.createDataFrame(rows, "doc_id string, text string, `a.b` int").selectExpr("*", "`a.b` as score")
    labels = table.selectExpr("doc_id", "`a.b` as quality").where("crc32(doc_id) % 2 = 0")
    machine = quality.fit(table, labels, "quality")
    got = quality.score(table, machine, name="p").collect()
    assert {(r["a.b"], r["score"], r["p"] >= 0.5) for r in got} == {(0, 0, False), (1, 1, True)}
    kept = quality.kept(table, machine)
    assert kept.schema == table.schema
    assert sorted(map(tuple, kept.collect())) == sorted(tuple(r)[:4] for r in got if r["p"] >= 0.5)
    assert quality.score(table, machine).columns == ["doc_id", "text", "a.b", "score"]


def test_score_equals_plain_sums(docs, spark):
    """Every score of a fitted machine, worked out pair by pair."""
    rows = [(i, "good words here " * (1 + i % 3) if i % 2 else "BAD !! " * (2 + i % 5), i % 2) for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string, good int")
    cfg = quality.FmConfig(buckets=64, rank=3, least_steps=20)
    machine = quality.fit(table, table, "good", cfg)
    texts = docs.select("text").dropDuplicates(["text"])
    for r in quality.score(texts, machine, cfg).collect():
        ids, values, _ = quality.features(pa.array([r["text"]], pa.string()), cfg)
        raw = machine.bias + sum(float(machine.weights[i]) * float(x) for i, x in zip(ids, values))
        v = machine.factors.astype(float)
        for a in range(len(ids)):
            for b in range(a):
                raw += float(v[ids[a]] @ v[ids[b]]) * float(values[a]) * float(values[b])
        assert abs(r["score"] - 1 / (1 + np.exp(-raw))) < 1e-4


def test_interactions_in_linear_time():
    machine = quality.Machine(0.3, np.array([1, 2, 3], np.float32), np.random.default_rng(0).normal(size=(3, 4)).astype(np.float32))
    x = np.array([0.5, 1.0, 2.0])
    v = machine.factors
    want = 0.3 + machine.weights @ x + sum(v[i] @ v[j] * x[i] * x[j] for i in range(3) for j in range(i))
    assert np.isclose(machine.raw(np.arange(3), x, np.array([0, 3]))[0][0], want, atol=1e-5)


def test_mixing(spark, docs, nothing):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randrange(5, 90)), rng.choice(["b", "a", "c", None, "Z"])) for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mixed(table).collect()
    total = collections.Counter()
    for _, t, s in rows:
        total[s] += len(t.split())
    names = sorted((s for s in total if s), key=lambda s: s.encode()) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    goal, open_ = {}, set(names)
    left = sum(total.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * total[s]}
        if not over:
            goal.update(share)
            break
        goal.update({s: 3 * total[s] for s in over})
        left -= sum(3 * total[s] for s in over)
        open_ -= over
    taken = collections.Counter()
    for r in plan:
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 3 * r["size"] and abs(r["target"] - goal[r["source"]]) < 1e-6 * goal[r["source"]]
    assert all(abs(taken[s] - goal[s]) <= 0.02 * goal[s] for s in names)
    assert sorted(map(tuple, plan), key=str) == sorted(map(tuple, mixing.mixed(table.repartition(3)).collect()), key=str)
    assert mixing.repeated(table).count() == sum(r["copies"] for r in plan)
    assert mixing.mixed(docs).count() == docs.count() and mixing.repeated(docs).columns == docs.columns
    assert mixing.mixed(nothing).count() == 0


def test_near_duplicates(docs, nothing):
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    for i in range(4, 8):
        assert got[i] == got[98 + i] == i
    assert got[304] == got[5] and got[None] == got[6] and got[300] == got[301] == got[302]
    assert len({got[i] for i in (2, 3, 200, 201, 303, 305)}) == 6
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(got.values()))
    assert near_dedup.near_duplicates(nothing).count() == 0 and near_dedup.keep_one(nothing).count() == 0


def test_banded_alignment_equals_full_table(monkeypatch):
    rng = random.Random(8)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    pairs, limits = [], []
    for _ in range(120):
        a = [rng.randrange(6) for _ in range(rng.randrange(0, 90))]
        b = [x for x in a if rng.random() > 0.1] + [rng.randrange(6) for _ in range(rng.randrange(4))]
        pairs.append((np.array(a, np.uint64), np.array(b, np.uint64)))
        limits.append(rng.randrange(0, 30))
    true = [distance(a.tolist(), b.tolist()) for a, b in pairs]
    for width, columns in [(256, 1024), (1, 1024), (5, 7)]:  # bands that must double, blocks that meet
        monkeypatch.setattr(near_dedup, "_WIDTH", width)
        monkeypatch.setattr(near_dedup, "_COLUMNS", columns)
        ok = near_dedup.edit_within(pairs, np.array(limits))
        assert ok.tolist() == [d <= n for d, n in zip(true, limits)]
        for (a, b), d in zip(pairs, true):
            found = near_dedup.banded(a, b, 12, 200)
            assert found == d if d <= 12 else found > 12


def test_token_files(docs, nothing, tmp_path):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    plain = Tokenizer.from_file(path)
    manifest = token_files.write(docs, path, str(tmp_path / "t"))
    got = [tuple(r) for r in token_files.read(manifest).collect()]
    at, want = 0, []
    for i, t in sorted(corpus(), key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or "")):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    file = manifest.where("n_docs > 2").first()["path"]
    with pa.OSFile(file) as source:
        reader = token_files.Reader(source)
        name = int(reader.names[-1])
        assert reader.document(name)[0][-1] == 2
    with open(file, "r+b") as f:
        f.seek(3)
        f.write(b"\x00\x01\x02\x03")
    with pa.OSFile(file) as source, pytest.raises(Exception):
        token_files.Reader(source).frame(0)
    assert token_files.read(token_files.write(nothing, path)).count() == 0


def test_pieces_encode_like_whole_texts():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    plain, encoder = Tokenizer.from_file(path), token_files.Encoder(path)
    rng = random.Random(6)
    letters = ["a", "É", "1", " ", " ", "'s", "t", ".", "\n", "\t", "中", "\u00a0", "e\u0301", "😀", "<|endoftext|>"]
    texts = ["".join(rng.choices(letters, k=rng.randrange(25))) for _ in range(3000)]
    got = encoder.encode(pa.array(texts))
    assert all(g.tolist() == plain.encode(t, add_special_tokens=False).ids for g, t in zip(got, texts))


def test_pipeline_keeps_what_it_should(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    table = queries.table(spark, sf_dir, "documents")
    sizes, now = [table.count()], table
    for name, stage in corpus_pipeline.STAGES[:3]:
        now = stage(spark, now, sf_dir).cache()
        assert now.columns == table.columns
        sizes.append(now.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.6 * sizes[0]
    assert now.dropDuplicates(["text"]).count() == sizes[-1]
    final = corpus_pipeline.run(spark, sf_dir)
    mixed = mixing.repeated(now)
    assert final.count() == mixed.count()
    assert sorted(r[0] for r in final.select("doc_id").collect()) == sorted(r[0] for r in mixed.select("doc_id").collect())
