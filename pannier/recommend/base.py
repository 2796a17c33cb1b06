"""What every recommender is: a few stored tables and a batch ``recommend``."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, ClassVar

from pyspark.sql import DataFrame

from pannier.operators.topk import Queries

MODELS: dict[str, type[Model]] = {}


@dataclass
class Model:
    """Subclasses name their tables; ``recommend`` returns query_id, rank, item_id, score."""

    params: dict[str, Any] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)

    name: ClassVar[str] = ""

    def __init_subclass__(cls, **kwargs: Any) -> None:
        super().__init_subclass__(**kwargs)
        if cls.name:
            MODELS[cls.name] = cls

    def recommend(self, queries: Queries, k: int = 10) -> DataFrame:
        raise NotImplementedError

    def components(self) -> dict[str, Model]:
        """Models this one is built on; they are saved along with it."""
        return {}
