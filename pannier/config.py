"""Settings of the jobs, as frozen dataclasses with the published defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

# The two order statuses that count as a completed order.
SUCCESS_STATUSES = ("Заказ доставлен", "Заказ получен")


@dataclass(frozen=True)
class DataConfig:
    separator: str = ","
    #: Quoted fields of order files may span lines; files known to have none can be split without it.
    multi_line: bool = True
    date_column: str = "created_at"
    item_id_column: str = "order_item_oms_id"
    success_statuses: tuple[str, ...] = SUCCESS_STATUSES
    min_basket_size: int = 2
    train_days: int = 365
    test_days: int = 30
    oot_days: int = 30


@dataclass(frozen=True)
class BoostConfig:
    """Blend of co-occurrence, category and text scores."""

    cooc_weight: float = 0.6
    category_weight: float = 0.25
    text_weight: float = 0.15
    min_support: int = 2
    score_metric: str = "npmi"
    tune_weights: bool = True
    #: Cases used to choose weights; 0 takes all.
    tune_max_cases: int = 0
    cooc_grid: tuple[float, ...] = (0.5, 0.6, 0.7)
    category_grid: tuple[float, ...] = (0.15, 0.25, 0.35)


@dataclass(frozen=True)
class TextConfig:
    max_features: int = 10_000
    ngram_range: tuple[int, int] = (1, 2)
    sublinear_tf: bool = True
    use_stopwords: bool = True


@dataclass(frozen=True)
class FactorConfig:
    factors: int = 64
    regularization: float = 0.01
    iterations: int = 15
    alpha: float = 1.0
    learning_rate: float = 0.01


@dataclass(frozen=True)
class EmbeddingConfig:
    vector_size: int = 64
    window: int = 5
    min_count: int = 2
    epochs: int = 20
    seed: int = 42


@dataclass(frozen=True)
class GraphConfig:
    min_support: int = 2
    walk_length: int = 20
    num_walks: int = 10
    embedding: EmbeddingConfig = field(
        default_factory=lambda: EmbeddingConfig(min_count=1, epochs=10)
    )


@dataclass(frozen=True)
class RankerConfig:
    n_candidates: int = 50
    rounds: int = 200
    learning_rate: float = 0.05
    max_depth: int = 5
    min_rows_per_leaf: int = 20
    feature_fraction: float = 0.8
    max_train_cases: int = 50_000
    val_ratio: float = 0.3
    use_history: bool = True
    seed: int = 42


@dataclass(frozen=True)
class TrainConfig:
    """Everything one training run needs; models without their inputs are skipped."""

    data: DataConfig = field(default_factory=DataConfig)
    models: tuple[str, ...] = (
        "TopPopular",
        "CooccurrenceLift",
        "Item2Vec",
        "ImplicitALS",
        "ImplicitBPR",
        "SessionCooccurrence",
        "ContentBoost",
        "ItemGraphNode2Vec",
        "STBoost",
        "PopularityRerank",
        "EnsembleRRF",
        "LGBMEnsemble",
    )
    only: str | None = None
    profile_models: tuple[str, ...] = (
        "CooccurrenceLift",
        "Item2Vec",
        "ImplicitALS",
        "ContentBoost",
        "ItemGraphNode2Vec",
    )
    cooc_min_support: int = 2
    cooc_metric: str = "npmi"
    session_min_support: int = 2
    history_weight: float = 0.3
    pop_weight: float = 0.2
    content: BoostConfig = field(default_factory=BoostConfig)
    dense: BoostConfig = field(
        default_factory=lambda: BoostConfig(
            cooc_weight=0.5,
            category_weight=0.2,
            text_weight=0.3,
            cooc_grid=(0.3, 0.4, 0.5, 0.6),
            category_grid=(0.1, 0.2, 0.3),
        )
    )
    text: TextConfig = field(default_factory=TextConfig)
    als: FactorConfig = field(default_factory=FactorConfig)
    bpr: FactorConfig = field(default_factory=lambda: FactorConfig(iterations=100))
    item2vec: EmbeddingConfig = field(default_factory=EmbeddingConfig)
    graph: GraphConfig = field(default_factory=GraphConfig)
    ranker: RankerConfig = field(default_factory=RankerConfig)
    ensemble_weights: tuple[tuple[str, float], ...] = (
        ("TopPopular", 1.0),
        ("CooccurrenceLift", 1.2),
        ("ContentBoost", 1.0),
        ("PopularityRerank", 0.8),
    )
    ensemble_min_hit5: float = 0.02
    n_buckets: int = 5
    k_values: tuple[int, ...] = (5, 10, 20)
    skip_zero_models: bool = True
    seed: int = 42
