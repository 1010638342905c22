"""URL filtering by a weighted vocabulary, under explicit host and path rules.

One Aho-Corasick automaton over all terms scans each URL once. A hit counts
only if the characters on both sides are not ASCII letters or digits, so that
``bets`` is not found in ``alphabets``. One strict term rejects the URL, and so
do SOFT_LIMIT distinct soft terms that weigh SOFT_WEIGHT together (each term
once). A rule that fits the URL overrides the vocabulary. ``read_vocabulary``
takes terms, kinds and weights from a table.

Defined results: a null URL, or one without ``://``, has an empty host and
path, fits no rule and is scanned as text (null: no hits); repeated rows are
judged row by row; columns beside id and URL are ignored; an empty table gives
an empty result. Only A-Z are lower-cased. The automaton and the rules are
parameters of fixed size, never taken from the data.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskline.llm.stage import table

#: Term -> weight. Fixed values.
STRICT: dict[str, int] = {"porn": 10, "xxx": 10, "casino": 8, "adult": 8, "escort": 8, "viagra": 8, "hentai": 10, "malware": 8, "phishing": 8, "warez": 6}
SOFT: dict[str, int] = {
    "ads": 2, "bet": 3, "bets": 3, "bonus": 2, "cheap": 2, "click": 1, "farm": 2, "free": 2, "jackpot": 3, "loan": 2,
    "pills": 3, "poker": 3, "promo": 2, "sex": 4, "spam": 3, "track": 1, "tracker": 2, "win": 2, "x": 1,
}
SOFT_LIMIT, SOFT_WEIGHT = 2, 3
#: Terms in one automaton, which every executor builds.
MAX_TERMS = 1_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str  # allow or block
    pattern: str  # host/path prefix


RULES = (Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"), Rule("allow", "com/fr/"), Rule("block", "com/de/"))
#: Rules become one expression; more than this belong in a table that is joined.
MAX_RULES = 200


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """Struct (pattern, verdict) of the longest rule that fits, or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES}")
    found = F.lit(None).cast("struct<pattern:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):
        name, slash, rest = r.pattern.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(r.pattern).alias("pattern"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def read_vocabulary(terms: DataFrame) -> tuple[dict[str, int], dict[str, int]]:
    """(strict, soft) of a table (term, kind, weight) of at most MAX_TERMS terms; blank terms go, the largest weight of a repeated term counts."""
    term = F.translate(F.trim("term"), UPPER, LOWER)
    rows = terms.select("kind", term.alias("term"), "weight").where("term <> ''").groupBy("kind", "term").agg(F.max("weight").alias("weight")).limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")
    strict, soft = ({r.term: r.weight for r in rows if r.kind == kind} for kind in ("strict", "soft"))
    return strict, soft


def vocabulary_hits(df: DataFrame, url_col: str = "url", strict: dict[str, int] = STRICT, soft: dict[str, int] = SOFT) -> DataFrame:
    """df's rows with n_strict, n_soft (distinct terms), soft_weight (of the distinct soft terms) and terms, an array in order of place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term in {**soft, **strict}:
            automaton.add_word(term, term)
        automaton.make_automaton()
        fold = str.maketrans(UPPER, LOWER)
        letter = lambda c: c.isascii() and c.isalnum()
        for batch in batches:
            n_strict, n_soft, weights, terms = [], [], [], []
            for url in batch.column(batch.schema.get_field_index(url_col)).to_pylist():
                u = (url or "").translate(fold)
                found = {}
                for last, term in automaton.iter(u):
                    first = last - len(term) + 1
                    if (first == 0 or not letter(u[first - 1])) and (last + 1 == len(u) or not letter(u[last + 1])):
                        found.setdefault(term, None)
                n_strict.append(sum(t in strict for t in found))
                n_soft.append(sum(t not in strict for t in found))
                weights.append(sum(soft[t] for t in found if t not in strict))
                terms.append(list(found))
            extra = [pa.array(n_strict, pa.int64()), pa.array(n_soft, pa.int64()), pa.array(weights, pa.int64()), pa.array(terms, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "n_strict", "n_soft", "soft_weight", "terms"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{kinds}, n_strict long, n_soft long, soft_weight long, terms array<string>")


def judge(df: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "page_id", url_col: str = "url", strict: dict[str, int] = STRICT, soft: dict[str, int] = SOFT) -> DataFrame:
    """(id, host, path, rule, verdict, hits...) for each row; one pass, no shuffle."""
    hits = vocabulary_hits(df.select(F.col(id_col), F.col(url_col).alias("url")), "url", strict, soft)
    hits = hits.select("*", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule = rule_for(rules, F.col("host"), F.col("path"))
    method = F.when((F.col("n_strict") > 0) | ((F.col("n_soft") >= SOFT_LIMIT) & (F.col("soft_weight") >= SOFT_WEIGHT)), "block").otherwise("allow")
    return hits.withColumn("_rule", rule).select(
        id_col, "host", "path", F.col("_rule.pattern").alias("rule"), F.coalesce("_rule.verdict", method).alias("verdict"), "n_strict", "n_soft", "soft_weight"
    )


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages -> page_id, host, path, rule, verdict, n_strict, n_soft, soft_weight."""
    return judge(table(spark, sf_dir, "pages"))


def _oracle() -> str:
    fold = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    hit = lambda t, w: f"CASE WHEN regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') THEN {w} ELSE 0 END"
    total = lambda terms: f"CAST({' + '.join(hit(t, w) for t, w in terms.items())} AS BIGINT)"
    once = lambda terms: dict.fromkeys(terms, 1)
    fits, rules = [], sorted(RULES, key=lambda r: -len(r.pattern))
    for r in rules:
        name, slash, rest = r.pattern.partition("/")
        fits.append(f"((host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{rest}'))")
    case = lambda values: "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, v in zip(fits, values, strict=True))
    return f"""
WITH p AS (SELECT page_id, {fold("coalesce(url, '')")} AS u,
  {fold("coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')")} AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
h AS (SELECT *, {total(once(STRICT))} AS n_strict, {total(once(SOFT))} AS n_soft, {total(SOFT)} AS soft_weight FROM p)
SELECT page_id, host, path, {case([r.pattern for r in rules])} ELSE NULL END AS rule,
  {case([r.verdict for r in rules])} WHEN n_strict > 0 OR (n_soft >= {SOFT_LIMIT} AND soft_weight >= {SOFT_WEIGHT}) THEN 'block' ELSE 'allow' END AS verdict,
  n_strict, n_soft, soft_weight FROM h"""


QUERIES = {"op10_url_filters": op10_url_filters}
ORACLES = {"op10_url_filters": _oracle()}
