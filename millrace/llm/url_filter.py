"""URL filter: host and path rules, then logistic regression on hashed character n-grams.

Defined results: a null url or one without ``://`` has an empty host and path,
fits no rule and is judged by the model on the empty text (allowed). Rows are
judged one by one, so repeated rows and empty tables need no care; of rules of
equal length a blocking one wins, then the first in order. Extra columns are
ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ._linear import fit_linear, gram_rows, sigmoid, sparse
from ._text import Block, blocks
from .url_table import builtin_labelled

#: Longest list of rules that goes into an expression; longer ones come as a table.
MAX_LISTED_RULES = 500
#: Most labelled urls that the model is fitted on, in the driver.
MAX_LABELLED = 20_000
BITS, ORDERS = 14, (3, 4)
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

def _host_path(url: str) -> tuple[str, str]:
    _, found, rest = url.partition("://")
    host = rest[: min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))]
    path = rest[len(host) :]
    return (host.translate(str.maketrans(_AZ, _AZ.lower())), path[: min([i for i in map(path.find, "?#") if i >= 0], default=len(path))]) if found else ("", "")


@lru_cache(maxsize=4)
def fit(labelled: tuple[tuple[str, int], ...]) -> tuple[np.ndarray, float]:
    """Weights and bias; raises ValueError for more than ``MAX_LABELLED`` rows."""
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"at most {MAX_LABELLED} labelled urls")
    b = Block(["".join(_host_path(u)).encode() for u, _ in labelled])
    r, f, v = sparse(*gram_rows(b, ORDERS, BITS), b.n, 1 << BITS)
    y = np.array([k for _, k in labelled])
    w, bias = fit_linear(r, f, v, y, 1 << BITS, l2=1e-6, steps=600)
    return w.astype(np.float32), bias


def url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``."""
    u = F.col(url)
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return df.withColumns({"host": F.translate(host, _AZ, _AZ.lower()), "path": path})


def with_rules(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds the longest fitting ``rule`` and its verdict as ``ruled``; needs ``host`` and ``path``."""
    if len(rules) > MAX_LISTED_RULES:
        raise ValueError(f"more than {MAX_LISTED_RULES} rules: give them as a DataFrame")
    rule = verdict = None
    for v, r in sorted(rules, key=lambda x: (-len(x[1]), x[0] != "block", x[1])):
        h, p = r[: r.index("/")], r[r.index("/") :]
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p))
        rule, verdict = (F.when(fits, r), F.when(fits, v)) if rule is None else (rule.when(fits, r), verdict.when(fits, v))
    none = F.lit(None).cast("string")
    return df.withColumns({"rule": none if rule is None else rule, "ruled": none if verdict is None else verdict})


def with_rules_table(df: DataFrame, rules: DataFrame) -> DataFrame:
    """As :func:`with_rules`, with rules of any number as a table (verdict, rule).

    Each distinct host and path is exploded to the host's suffixes, which join the rules' hosts by equality.
    """
    r = rules.select("verdict", "rule", F.substring_index("rule", "/", 1).alias("_h"), F.expr("substr(rule, instr(rule, '/'))").alias("_p"))
    parts = F.split("host", r"\.", -1)
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat_ws(".", F.slice(parts, k, F.size(parts))))
    hit = df.select("host", "path").distinct().select("host", "path", F.explode(tails).alias("_h")).join(r, "_h").where(F.startswith("path", F.col("_p")))
    best = hit.groupBy("host", "path").agg(F.min(F.struct((-F.length("rule")).alias("n"), (F.col("verdict") != "block").alias("b"), F.col("rule"), F.col("verdict"))).alias("_m"))
    return df.join(best, ["host", "path"], "left").withColumns({"rule": F.col("_m.rule"), "ruled": F.col("_m.verdict")}).drop("_m")


def url_filter(df: DataFrame, rules: list[tuple[str, str]] | DataFrame, labelled: list[tuple[str, int]] | None = None, page_id: str = "page_id", url: str = "url", threshold: float = 0.5) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict (allow or block), score (probability of block by the model).

    ``rules``: (verdict, rule) pairs, or a table of these columns; ``labelled``: (url, 1 to block) rows for the model.
    """
    ship(df.sparkSession)
    weights, bias = fit(tuple(labelled if labelled is not None else builtin_labelled()))
    model = df.sparkSession.sparkContext.broadcast((weights, bias))  # 2 ** BITS floats

    def score(batches):
        w, b0 = model.value
        for batch in batches:
            for part, b in blocks(batch, "_t", 1 << 20):
                s = np.full(b.n, b0)
                rows, feats = gram_rows(b, ORDERS, BITS)
                if len(rows):
                    r, f, v = sparse(rows, feats, b.n, 1 << BITS)
                    s += np.bincount(r, v * w[f], b.n)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sigmoid(s))], [*part.schema.names[:-1], "score"])

    base = url_parts(df.select(F.col(page_id).alias("page_id"), F.col(url).alias("_url")), "_url")
    base = (with_rules_table if isinstance(rules, DataFrame) else with_rules)(base, rules).select("page_id", "host", "path", "rule", "ruled", F.concat("host", "path").alias("_t"))
    kind = dict(base.dtypes)["page_id"]
    out = base.mapInArrow(score, f"page_id {kind}, host string, path string, rule string, ruled string, score double")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
