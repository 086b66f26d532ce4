"""Score bands, the critical flag and dates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HIGH_ABOVE = 0.6
MEDIUM_ABOVE = 0.4
CRITICAL_SIMILARITY_ABOVE = 0.55
CRITICAL_KEYWORDS_FROM = 3


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_score(score) -> Column:
    """NaN as NULL: Spark orders NaN above every number, which would put it into the top band."""
    c = _c(score)
    return F.when(~F.isnan(c), c)


def risk_band(score="risk_score", missing: str | None = "Low") -> Column:
    """High / Medium / Low with strict limits; a missing score takes ``missing`` (None for no band)."""
    c = clean_score(score)
    return (
        F.when(c > HIGH_ABOVE, "High")
        .when(c > MEDIUM_ABOVE, "Medium")
        .when(c.isNotNull(), "Low")
        .otherwise(F.lit(missing))
    )


def is_critical(
    similarity="similarity_score",
    keywords="num_keywords_matched",
    sim_threshold: float = CRITICAL_SIMILARITY_ABOVE,
    min_keywords: int = CRITICAL_KEYWORDS_FROM,
) -> Column:
    by_sim = F.coalesce(clean_score(similarity) > sim_threshold, F.lit(False))
    return by_sim | F.coalesce(_c(keywords) >= min_keywords, F.lit(False))


def parse_timestamp(text) -> Column:
    return F.try_to_timestamp(_c(text).cast("string"))
