"""Rewriting text and tables with a mapping, in one map-only pass.

``mask_text`` replaces known terms at word boundaries (``_`` separates words),
in one pass from left to right whose output is never read again. At each place
the categories are tried in order, and within one the longest term first. A
term is known by its words, in lower case: white space and punctuation between
and around them do not count, as in the leak scan, so that no spelling that the
scan finds is left. What stands around a term in the text stays.
Runs of five or more digits, and codes, that no term covers get a fake of their
shape; such fakes are a function of seed and text, so the mapping's own are not
sent where it has no other fake for them.

Text is lower-cased before it is split into words, as in the scan. A column of
arrays is masked entry by entry: no term reaches from one into the next. With
hits each replacement is told with its place, and ``spans`` makes these one
table (row, column, start, end, category, real, fake), of which statistics and
unmapped runs are aggregates.

A mapping of up to MAX_TERMS terms is sent to the executors after it is
counted; with a larger one each row gets the terms that it holds by join.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskline.functions import text as t
from maskline.operators.identifiers import locate_terms
from maskline.operators.related import HARVESTED
from maskline.operators.rows import heading, sections
from maskline.shared import shared_dir, written

#: Order of categories at one place: related tables, and the ledger.
RELATED = ("street", "address", "acctnum", "llc", "name", "town", "propcode", "entcode", "last4", "glued", "run", "code")
LEDGER = ("account_name", "name", "town", "acctnum", "run", "last4", "code")
#: Categories whose terms also stand between other letters than ASCII.
ASCII_BOUND = ("propcode", "entcode", "last4", "run")
MAX_TERMS = 200_000
HIT = ("kind", "real", "fake", "start", "end")
HITS = "array<struct<kind:string,real:string,fake:string,start:int,end:int>>"

_PARTS = re.compile(r"[^\W_]+")
_ASCII, _DIGITS = re.compile("[A-Za-z0-9]+"), re.compile("[0-9]+")
_RUN, _CODE = re.compile(r"[0-9]{5,}"), re.compile(r"(?=.*[A-Za-z])(?=.*[0-9].*[0-9])[A-Za-z0-9]{5,}")


@lru_cache(maxsize=100_000)
def shape_fake(text: str, seed: str, category: str, salt: int = 0) -> str:
    """The same function as the column function of this name."""
    out = []
    for i, c in enumerate(text, 1):
        n = int(hashlib.sha256(f"{seed}|{category}|{text}|{salt}|{i}".encode()).hexdigest()[:8], 16)
        if "0" <= c <= "9":
            c = chr(48 + n % 10)
        elif "A" <= c <= "Z":
            c = chr(65 + n % 26)
        elif "a" <= c <= "z":
            c = chr(97 + n % 26)
        out.append(c)
    return "".join(out)


class Word(NamedTuple):
    low: str
    start: int
    end: int


def split_words(text: str) -> list[Word]:
    """Words of the text in lower case, with their places in the text itself."""
    low = text.lower()
    if len(low) == len(text):
        return [Word(m[0], m.start(), m.end()) for m in _PARTS.finditer(low)]
    own = [k for k, c in enumerate(text) for _ in c.lower()]  # a capital may become two characters
    return [Word(m[0], own[m.start()], own[m.end() - 1] + 1) for m in _PARTS.finditer(low)]


def _inner(real: str, fake: str, start: int, end: int) -> str:
    """The fake without what stands around the real's words and stays in the text."""
    head, tail = real[:start], real[end:]
    fake = fake[len(head) :] if head and fake.startswith(head) else fake
    return fake[: len(fake) - len(tail)] if tail and fake.endswith(tail) else fake


class Terms:
    """Terms by their words in lower case, and by first word how many words they may have."""

    def __init__(self, rows: Sequence[tuple[str, str, str]], order: Sequence[str]):
        rank = {c: k for k, c in enumerate(order)}
        self.by_words: dict[str, tuple[int, str, str]] = {}
        lengths: dict[str, set[int]] = {}
        for category, real, fake in rows:
            words = split_words(real)
            if category in rank and words:
                low = [w.low for w in words]
                entry = rank[category], category, _inner(real, fake, words[0].start, words[-1].end)
                key = " ".join(low)
                self.by_words[key] = min(entry, self.by_words.get(key, entry))
                lengths.setdefault(low[0], set()).add(len(low))
        self.lengths = {w: sorted(n, reverse=True) for w, n in lengths.items()}

    def _inside(self, word: str, at: int, seed: str, blanket: bool, digits: bool, hits: list[tuple]) -> str:
        """A word (from place at) that is no term, with the numbers and codes inside it replaced: between other characters than ASCII letters and digits, or (digits) than digits."""

        def one(m: re.Match) -> str:
            known = self.by_words.get(m[0].lower())
            if known and known[1] in ASCII_BOUND:
                kind, fake = known[1:]
            elif blanket and (kind := "run" if _RUN.fullmatch(m[0]) else "code" if _CODE.fullmatch(m[0]) else None):
                fake = shape_fake(m[0], seed, kind)
            else:
                return m[0]
            hits.append((kind, m[0], fake, at + m.start(), at + m.end()))
            return fake

        return (_DIGITS if digits else _ASCII).sub(one, word)

    def mask(self, text: str | None, seed: str, blanket: bool, digits: bool = False) -> tuple[str | None, list[tuple]]:
        """(masked text, HITs with places in the text given)."""
        if not text:
            return text, []
        words = split_words(text)
        low = [w.low for w in words]
        out, hits, at, k = [], [], 0, 0
        while k < len(words):
            best = None
            for n in self.lengths.get(low[k], ()):
                found = self.by_words.get(" ".join(low[k : k + n])) if k + n <= len(words) else None
                if found and (best is None or found[0] < best[0]):
                    best = *found, n
            start, end = words[k].start, words[k + (best[3] if best else 1) - 1].end
            start = max(start, at)  # two words may share a capital that becomes two characters
            if best:
                fake = best[2]
                hits.append((best[1], text[start:end], fake, start, end))
            else:
                fake = self._inside(text[start:end], start, seed, blanket, digits, hits)
            out += [text[at:start], fake]
            at, k = end, k + (best[3] if best else 1)
        return "".join([*out, text[at:]]), hits


def needed(mapping: DataFrame, seed: str, blanket: bool) -> DataFrame:
    """(category, real, fake) without the runs and codes for which the blanket rule has the same fake."""
    rows = mapping.select("category", "real", "fake")
    if not blanket:
        return rows
    rows = rows.repartition(mapping.sparkSession.sparkContext.defaultParallelism)  # shapes cost time, not bytes: they are dealt to all tasks
    run = (F.col("category") == "run") & F.col("real").rlike("^[0-9]{5,}$") & (F.col("fake") == t.shape_fake(F.col("real"), seed, "run"))
    code = (F.col("category") == "code") & F.col("real").rlike("^[A-Za-z0-9]+$") & t.is_code(F.col("real")) & (F.col("fake") == t.shape_fake(F.col("real"), seed, "code"))
    return rows.where(~(run | code))


def mask_text(df: DataFrame, columns: Sequence[str], mapping: DataFrame, seed: str, order: Sequence[str] = RELATED, blanket: bool = True, hits: bool = False, digits: bool = False) -> DataFrame:
    """df with the columns, of text or of arrays of texts, masked by mapping (category, real, fake); hits adds ``<column>_hits``, for text.

    digits (for file names) takes a number that is a term wherever no other digit is beside it.
    """
    terms = written(needed(mapping, seed, blanket), shared_dir(df.sparkSession), "terms")
    if terms.count() > MAX_TERMS:
        return by_join(df, columns, terms, seed, order, blanket, hits, digits)
    shared = df.sparkSession.sparkContext.broadcast(Terms([tuple(r) for r in terms.collect()], order))  # counted

    def mask(texts: pd.Series) -> pd.DataFrame:
        return _result([shared.value.mask(x, seed, blanket, digits) for x in texts], hits)

    return _replaced(df, df.columns, columns, mask, [], hits)


def by_join(df: DataFrame, columns: Sequence[str], terms: DataFrame, seed: str, order: Sequence[str] = RELATED, blanket: bool = True, hits: bool = False, digits: bool = False) -> DataFrame:
    """The same for any number of terms (category, real, fake): each row gets the few that it may hold."""
    none = Terms([], order)

    def mask(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        own = (none if rows is None else Terms([(r["category"], r["term"], r["fake"]) for r in rows], order) for rows in found)
        return _result([terms.mask(x, seed, blanket, digits) for x, terms in zip(texts, own, strict=True)], hits)

    return _replaced(_with_terms(df, columns, terms), df.columns, columns, mask, [F.col("_terms")], hits)


def _result(done: list[tuple[str | None, list[tuple]]], hits: bool) -> pd.DataFrame | pd.Series:
    texts = [x for x, _ in done]
    if not hits:
        return pd.Series(texts, dtype=object)
    return pd.DataFrame({"text": texts, "hits": [[dict(zip(HIT, h, strict=True)) for h in found] for _, found in done]})


def _replaced(df: DataFrame, names: Sequence[str], columns: Sequence[str], mask, own: list[Column], hits: bool) -> DataFrame:
    @F.pandas_udf("string")
    def texts(*parts: pd.Series) -> pd.Series:
        return mask(*parts)

    @F.pandas_udf("array<string>")
    def cells(rows: pd.Series, *more: pd.Series) -> pd.Series:
        sizes = [0 if row is None else len(row) for row in rows]
        each = lambda values: pd.Series([x for x, n in zip(values, sizes, strict=True) for _ in range(n)], dtype=object)
        done = iter(mask(pd.Series([x for row in rows if row is not None for x in row], dtype=object), *(each(m) for m in more)))
        return pd.Series([None if row is None else [next(done) for _ in row] for row in rows], dtype=object)

    @F.pandas_udf(f"struct<text:string,hits:{HITS}>")
    def texts_and_hits(*parts: pd.Series) -> pd.DataFrame:
        return mask(*parts)

    for c in columns:
        f = texts_and_hits if hits else cells if df.schema[c].dataType.typeName() == "array" else texts
        df = df.withColumn(f"_m_{c}", f(F.col(f"`{c}`"), *own))
    at = lambda c, part: F.col(f"`_m_{c}`")[part] if hits else F.col(f"`_m_{c}`")
    more = [at(c, "hits").alias(f"{c}_hits") for c in columns] if hits else []
    return df.select(*(at(c, "text").alias(c) if c in columns else F.col(f"`{c}`") for c in names), *more)


def spans(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys..., column, start, end, category, real, fake): a row for each replacement, of a table masked with hits. Places count from 0 in the text before."""
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"{c}_hits").alias("hits")) for c in columns))
    rows = df.select(*keys, F.explode(each).alias("x")).select(*keys, "x.column", F.explode("x.hits").alias("h"))
    return rows.select(*keys, "column", "h.start", "h.end", F.col("h.kind").alias("category"), "h.real", "h.fake")


def replacement_counts(found: DataFrame) -> DataFrame:
    """(kind, n): replacements by category, of spans."""
    return found.groupBy(F.col("category").alias("kind")).agg(F.count("*").alias("n"))


def unmapped_runs(found: DataFrame, mapping: DataFrame) -> DataFrame:
    """(run, n): digit runs that were replaced by their shape alone, since the mapping lacks them, of spans."""
    known = mapping.where("category = 'run'").select("real")
    return found.where("category = 'run'").join(known, "real", "left_anti").groupBy(F.col("real").alias("run")).agg(F.count("*").alias("n"))


def _with_terms(df: DataFrame, columns: Sequence[str], terms: DataFrame) -> DataFrame:
    """df, written with a row number, and the few terms that each row may hold. Only places of first words are shuffled, never texts of other rows."""
    rows = written(df.withColumn("_uid", F.monotonically_increasing_id()), shared_dir(df.sparkSession), "rows")
    wanted = terms.withColumnRenamed("real", "term")
    inner = wanted.where(F.col("category").isin(*ASCII_BOUND))
    found = locate_terms(rows, "_uid", list(columns), wanted, ("category", "term", "fake")).select("_uid", "category", "term", "fake")
    # numbers and codes inside words that have other letters beside them
    tokens = rows.select("_uid", F.explode(F.array_distinct(F.concat(*(f(F.lower(F.col(f"`{c}`").cast("string"))) for c in columns for f in (t.alnum_tokens, t.all_digits))))).alias("token"))
    inside = tokens.join(inner.withColumn("token", F.lower("term")), "token").select("_uid", "category", "term", "fake")
    own = found.union(inside).distinct().groupBy("_uid").agg(F.collect_list(F.struct("category", "term", "fake")).alias("_terms"))
    return rows.join(own, "_uid", "left")


def mask_tokens(df: DataFrame, id_col: str, column: str, terms: DataFrame) -> DataFrame:
    """df with single words of a column replaced by terms (real, fake), by case-blind join: JVM only, for any number of terms. id is unique.

    Only words that are terms come back to their row, as a map of that row's own.
    """
    words = df.select(id_col, F.explode(F.array_distinct(t.words(F.col(column)))).alias("w"))
    known = terms.select(F.lower("real").alias("w"), "fake")
    own = words.join(known, "w").groupBy(id_col).agg(F.map_from_entries(F.collect_set(F.struct("w", "fake"))).alias("_fakes"))  # words of one cell
    parts = F.regexp_extract_all(F.col(column), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))
    masked = F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at("_fakes", F.lower(p)), p)), "")
    return df.join(own, id_col, "left").withColumn(column, F.when(F.col("_fakes").isNull(), F.col(column)).otherwise(masked)).select(*df.columns)


def normalize_accounts(df: DataFrame, accounts: DataFrame) -> DataFrame:
    """account_num and institution replaced through accounts (key, fake_number, institution); what has no account stays."""
    keyed = df.withColumn("_key", F.when(t.filled(F.col("account_num")), t.account_key(F.col("account_num"))))
    info = accounts.select(F.col("key").alias("_key"), F.col("fake_number").alias("_fake"), F.col("institution").alias("_inst"))
    return (
        keyed.join(info, "_key", "left")
        .withColumn("account_num", F.coalesce("_fake", "account_num"))
        .withColumn("institution", F.coalesce(F.nullif("_inst", F.lit("")), "institution"))
        .select(*df.columns)
    )


def mask_ledger(df: DataFrame, mapping: DataFrame, accounts: DataFrame, seed: str, factor: str | None = None, hits: bool = False) -> DataFrame:
    """Ledger rows: texts masked, account numbers and institutions by key, amounts scaled if a factor is given, the rest as it is."""
    df = normalize_accounts(df, accounts)
    df = df.withColumn("amount", t.scale_amount_text(F.col("amount"), factor)) if factor else df
    return mask_text(df, ["description", "account"], mapping, seed, LEDGER, hits=hits)


def mask_statements(rows: DataFrame, headers: DataFrame, mapping: DataFrame, seed: str, factor: str | None = None, column: str = "description") -> DataFrame:
    """Statement rows (file, row_no, cells): the description column masked, preamble cells too, each by itself, money scaled if a factor is given."""
    names = headers.join(rows, "file").where("row_no = header_row").select("file", F.transform("cells", lambda c: F.lower(t.clean(c))).alias("_names"))
    parts = sections(rows, headers).join(names, "file")
    wide = parts.withColumn("_at", F.array_position("_names", column))
    described = F.when((F.col("section") == "data") & (F.col("_at") > 0), F.array(F.try_element_at("cells", F.col("_at").cast("int")))).when(F.col("section") == "preamble", F.col("cells"))
    wide = mask_text(wide.withColumn("_texts", described), ["_texts"], mapping, seed)
    money = lambda c: t.scale_amount_text(c, factor) if factor else c
    named = F.transform("cells", lambda c, i: F.when((i + 1) == F.col("_at"), F.coalesce(F.get("_texts", F.lit(0)), c)).otherwise(F.when(F.get("_names", i).isin(*t.MONEY_NAMES), money(c)).otherwise(c)))
    cells = F.when(F.col("section") == "data", named).when(F.col("section") == "preamble", F.transform("_texts", money)).otherwise(F.col("cells"))
    return wide.select("file", "row_no", cells.alias("cells"))


def mask_table(df: DataFrame, mapping: DataFrame, accounts: DataFrame, seed: str, factor: str | None = None, addresses: DataFrame | None = None, money: Sequence[str] = ()) -> DataFrame:
    """Any table: per column, whole-number account, money, other types, word accounts, institution, address, text, in this order.

    The columns that are harvested for account numbers (bank columns too) are those that are masked by account.

    An account cell without a digit (``cash``) is replaced only in account and
    account number columns, where it is the whole cell.
    """
    names, texts = list(df.columns), []
    keyed = accounts.select(F.col("key").alias("_k"), F.col("fake_last4").cast("bigint").alias("_f4"), F.col("fake_number").alias("_f"))
    for f in df.schema.fields:
        low, kind, c = f.name.strip().lower(), f.dataType.typeName(), F.col(f"`{f.name}`")
        number = HARVESTED.get(heading(f.name)) == "account_num" or ("account" in low and ("num" in low or "#" in low))
        priced = factor and (f.name in money or (not money and t.is_money_column(f.name)))
        if kind != "string":
            if number and kind in ("integer", "long", "double", "short"):
                key = F.pmod(c.cast("bigint"), F.lit(10_000)).cast("string")
                df = df.join(keyed, key == F.col("_k"), "left").withColumn(f.name, F.coalesce(F.col("_f4").cast(f.dataType), c)).drop(*keyed.columns)
            elif priced and kind in ("decimal", "double", "float", "integer", "long"):
                df = df.withColumn(f.name, F.coalesce(t.scale(c, factor).cast(f.dataType), c))
        elif low == "institution":
            continue
        elif number or low == "account":
            key = t.account_key(c)
            whole = F.when(t.filled(c) & (F.lit(number) | ~c.rlike("[0-9]")), key)
            df = df.join(keyed, whole == F.col("_k"), "left")
            if number:
                df = df.withColumn(f.name, F.coalesce("_f", c)).drop(*keyed.columns)
            else:  # a word account is the cell; any other account is text
                df, texts = df.withColumn(f"_account_{f.name}", F.col("_f")).drop(*keyed.columns), [*texts, f.name]
        elif low == "address" and addresses is not None:
            info = addresses.where("fake <> ''").select(F.col("real").alias("_k"), F.col("fake").alias("_f"))
            df = df.join(info, c == F.col("_k"), "left").withColumn(f"_address_{f.name}", F.col("_f")).drop("_k", "_f")
            texts.append(f.name)
        elif priced:
            df = df.withColumn(f.name, t.scale_amount_text(c, factor))
        else:
            texts.append(f.name)
    df = mask_text(df, texts, mapping, seed) if texts else df
    fixed = lambda n: [F.col(f"`{x}`") for x in (f"_account_{n}", f"_address_{n}") if x in df.columns]
    return df.select(*(F.coalesce(*fixed(n), F.col(f"`{n}`")).alias(n) for n in names))


def mask_file_names(df: DataFrame, column: str, mapping: DataFrame, seed: str) -> DataFrame:
    """df with names of files masked: known terms only, last fours wherever no digit is beside them, and characters that names cannot hold made ``_``."""
    parts = df.withColumn("_stem", F.regexp_replace(column, r"\.[^.]*$", "")).withColumn("_end", F.regexp_extract(column, r"(\.[^.]*)?$", 1))
    masked = mask_text(parts, ["_stem"], mapping, seed, blanket=False, digits=True)
    return masked.withColumn(column, F.concat(F.regexp_replace("_stem", r'[<>:"/\\|?*]', "_"), F.col("_end"))).select(*df.columns)


def glued_names(words: DataFrame, names: DataFrame, least: int = 3) -> DataFrame:
    """(word, first, second): words that are two known names without a space, the longest first part wins, words that are names excluded.

    words (word) are distinct, so each text is split once.
    """
    known = names.select(F.lower("real").alias("w"), "fake").where(F.col("w").rlike(r"^\p{L}+$")).distinct()
    splits = words.where(F.col("word").rlike(r"^\p{L}+$") & (F.length("word") >= 2 * least)).join(known.select(F.col("w").alias("word")), "word", "left_anti")
    splits = splits.select("word", F.explode(F.sequence(F.lit(least), F.length("word") - least)).alias("k"))
    splits = splits.select("word", F.substr("word", F.lit(1), F.col("k")).alias("first"), F.substr("word", F.col("k") + 1, F.length("word")).alias("second"))
    hit = splits.join(known.select(F.col("w").alias("first"), F.col("fake").alias("fake1")), "first").join(known.select(F.col("w").alias("second"), F.col("fake").alias("fake2")), "second")
    best = F.max_by(F.struct("first", "second", F.concat("fake1", "fake2").alias("fake")), F.length("first")).alias("b")
    return hit.groupBy("word").agg(best).select("word", "b.first", "b.second", "b.fake")
