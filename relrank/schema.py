"""Table schemas, the label scale and the feature order."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------------
LABEL_GRADES = {"Exact": 2, "Partial": 1, "Irrelevant": 0}
SPLITS = ("train", "validation", "test")

QUERY_COLUMNS = ["query_id", "query", "query_class"]
PRODUCT_COLUMNS = [
    "product_id",
    "product_name",
    "product_class",
    "category_hierarchy",
    "product_description",
    "product_features",
    "rating_count",
    "average_rating",
    "review_count",
]
LABEL_COLUMNS = ["id", "query_id", "product_id", "label"]

LEXICAL_FEATURES = [
    "bm25_score",
    "tfidf_similarity",
    "exact_match",
    "token_overlap",
    "character_overlap",
    "query_title_overlap",
]
TEXT_FEATURES = ["title_length", "description_length", "feature_count", "category_depth"]
METADATA_FEATURES = ["average_rating", "rating_count", "review_count"]
COMPATIBILITY_FEATURES = ["category_match", "product_class_match", "phrase_match"]
SEMANTIC_FEATURES = ["semantic_similarity", "query_embedding_norm", "product_embedding_norm"]
# ----------------------------------------------------------------------------------

ALL_FEATURES = (
    LEXICAL_FEATURES
    + TEXT_FEATURES
    + METADATA_FEATURES
    + COMPATIBILITY_FEATURES
    + SEMANTIC_FEATURES
)
# The ranker does not see the two vector norms.
MODEL_FEATURES = [f for f in ALL_FEATURES if not f.endswith("_embedding_norm")]

# The raw files spell this column with a space; tables inside the package do not.
RAW_CATEGORY = "category hierarchy"


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_LONG, _TEXT, _DOUBLE, _INT = T.LongType(), T.StringType(), T.DoubleType(), T.IntegerType()

QUERY_SCHEMA = _struct(query_id=_LONG, query=_TEXT, query_class=_TEXT)
PRODUCT_SCHEMA = T.StructType(
    [
        T.StructField("product_id", _LONG),
        T.StructField("product_name", _TEXT),
        T.StructField("product_class", _TEXT),
        T.StructField(RAW_CATEGORY, _TEXT),
        T.StructField("product_description", _TEXT),
        T.StructField("product_features", _TEXT),
        T.StructField("rating_count", _DOUBLE),
        T.StructField("average_rating", _DOUBLE),
        T.StructField("review_count", _DOUBLE),
    ]
)
LABEL_SCHEMA = _struct(id=_LONG, query_id=_LONG, product_id=_LONG, label=_TEXT)
RANKING_SCHEMA = _struct(query_id=_LONG, product_id=_LONG, score=_DOUBLE, rank=_INT)
REQUEST_SCHEMA = _struct(
    request_id=_TEXT,
    query=_TEXT,
    top_k=_INT,
    products=T.ArrayType(
        _struct(
            product_id=_LONG,
            product_name=_TEXT,
            product_class=_TEXT,
            category_hierarchy=_TEXT,
            product_description=_TEXT,
            product_features=_TEXT,
            rating_count=_DOUBLE,
            average_rating=_DOUBLE,
            review_count=_DOUBLE,
        )
    ),
)
AUDIT_SCHEMA = _struct(
    request_id=_TEXT,
    query=_TEXT,
    candidate_count=_INT,
    top_k=_INT,
    model_name=_TEXT,
    model_alias=_TEXT,
    latency_ms=_DOUBLE,
    created_at=T.TimestampType(),
)
