"""Column functions over the text of identifiers, amounts and addresses. All built in, none leaves the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Account-type words that end an account name. Fixed values.
SUFFIXES = ("ck", "chk", "checking", "check", "savings", "sav", "sv", "llc", "inc", "corp", "co", "trust", "mgmt", "holdings", "ops", "fund", "escrow", "bus", "business", "biz", "visa", "card", "cc", "loan", "paypal", "credit")
#: Words in a column's name that mark money, and whole names of statement columns. Fixed values.
MONEY_WORDS = ("amount", "balance", "deposit", "building", "land", "depreciation", "mortgage", "cash", "rent", "value", "price", "cost", "fee", "income", "expense")
MONEY_NAMES = ("amount", "running bal.", "running balance", "balance", "summary amt.")

SPACE = r"^\s+|\s+$"
WORD = r"[\p{L}\p{N}]+"


def clean(c: Column) -> Column:
    """Null becomes empty; white space at both ends goes."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), SPACE, "")


def filled(c: Column) -> Column:
    return clean(c) != ""


def digit_runs(c: Column) -> Column:
    """Runs of five or more digits."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\d{5,}"), F.lit(0))


def all_digits(c: Column) -> Column:
    """Every maximal run of digits."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[0-9]+"), F.lit(0))


def alnum_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0))


def is_code(t: Column) -> Column:
    """Five or more characters with a letter and at least two digits."""
    return (F.length(t) >= 5) & t.rlike("[A-Za-z]") & (F.length(F.regexp_replace(t, "[^0-9]", "")) >= 2)


def alnum_codes(c: Column) -> Column:
    return F.filter(alnum_tokens(c), is_code)


def account_key(c: Column) -> Column:
    """Last four digits without leading zeros; without digits the trimmed text in capitals."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.when(digits != "", F.right(digits, F.lit(4)).cast("int").cast("string")).otherwise(F.upper(F.trim(c)))


def bare_form(key: Column) -> Column:
    """Four-digit form of a numeric key, else null."""
    return F.when(key.rlike("^[0-9]+$"), F.lpad(key, 4, "0"))


def split_core(c: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """Struct (core, suffix): an account-type word at the end of two or more words is the suffix."""
    words = F.split(F.trim(c), r"\s+")
    last = F.lower(F.regexp_replace(F.element_at(words, -1), "^[.,]+|[.,]+$", ""))
    cut = (F.size(words) > 1) & last.isin(*suffixes)
    return F.struct(
        F.when(cut, F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1))), " ")).otherwise(F.array_join(words, " ")).alias("core"),
        F.when(cut, F.element_at(words, -1)).otherwise(F.lit("")).alias("suffix"),
    )


def compound_parts(c: Column) -> Column:
    """Struct (name, number, code) of ``name - number (code)``; nulls where the text has another form."""
    form = r"^(.*?) - (\S+) \(([^)]+)\)\s*$"
    part = lambda k: F.when(c.rlike(form), F.trim(F.regexp_extract(c, form, k)))
    return F.struct(part(1).alias("name"), part(2).alias("number"), part(3).alias("code"))


def parse_address(c: Column) -> Column:
    """Struct (street, city, state, zip) of a comma-separated address; empty where absent."""
    parts = F.filter(F.transform(F.split(c, ","), lambda s: F.trim(s)), lambda x: x != "")
    part = lambda k: F.coalesce(F.get(parts, F.lit(k)), F.lit(""))
    before = F.regexp_extract(c, r"\b([A-Za-z]{2})\b[,\s]*\d{5}", 1)
    return F.struct(
        part(0).alias("street"), part(1).alias("city"),
        F.coalesce(F.nullif(before, F.lit("")), F.regexp_extract(c, r",\s*([A-Za-z]{2})\b", 1)).alias("state"),
        F.regexp_extract(c, r"\b(\d{5})\b", 1).alias("zip"),
    )


def build_address(street: Column, city: Column, state: Column, zip_code: Column) -> Column:
    """``street, city, ST ZIP`` without the empty parts."""
    tail = F.trim(F.concat_ws(" ", state, zip_code))
    return F.array_join(F.filter(F.array(street, city, tail), lambda x: x != ""), ", ")


def keyed_number(seed: str, category: str, *parts: Column) -> Column:
    """First 32 bits of SHA-256 over the seed, the category and the parts."""
    text = F.concat_ws("|", F.lit(seed), F.lit(category), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("bigint")


def shape_fake(c: Column, seed: str, category: str, salt: Column | int = 0) -> Column:
    """Text of the same shape: digits stay digits and letters keep their case; a function of (seed, category, text, salt) alone."""
    salted = F.lit(salt) if isinstance(salt, int) else salt

    def fake(i: Column) -> Column:
        ch = F.substr(c, i, F.lit(1))
        n = keyed_number(seed, category, c, salted, i)
        pick = lambda base, size: F.char(F.lit(base) + n % size)
        return F.when(ch.rlike("[0-9]"), pick(48, 10)).when(ch.rlike("[A-Z]"), pick(65, 26)).when(ch.rlike("[a-z]"), pick(97, 26)).otherwise(ch)

    return F.when(F.length(c) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(c)), fake), "")).otherwise(c)


def scrub_codes(c: Column, seed: str) -> Column:
    """The text with every bounded run of five or more digits, and every code, replaced by a fake of its shape."""
    tokens = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[A-Za-z0-9]+|[^A-Za-z0-9]+"), F.lit(0))
    swap = lambda t: F.when(t.rlike("^[0-9]{5,}$"), shape_fake(t, seed, "run")).when(is_code(t) & t.rlike("^[A-Za-z0-9]+$"), shape_fake(t, seed, "code")).otherwise(t)
    # only the few texts that hold such a token are taken apart
    return F.when(c.rlike("[A-Za-z0-9]{5}") & c.rlike("[0-9]"), F.array_join(F.transform(tokens, swap), "")).otherwise(c)


def property_code(street: Column) -> Column:
    """Three characters of the street's number at most, a dash, and the first three letters of the word after it, in capitals."""
    parts = F.split(F.trim(street), r"\s+")
    letters = F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"[^\p{L}]", "")
    return F.concat(F.substring(F.get(parts, F.lit(0)), 1, 3), F.lit("-"), F.upper(F.substring(letters, 1, 3)))


#: ``1,234.56``: two decimals, with an optional minus or ``$`` in either order, and parentheses on both sides or on none.
MONEY = r"^\s*(?:-?\$?|\$-)[0-9,]+\.[0-9]{2}\s*$|^\s*\(-?\$?[0-9,]+\.[0-9]{2}\)\s*$"
AMOUNT = "decimal(18,2)"


def parse_money(c: Column) -> Column:
    """decimal(18,2), or null where the text is no amount or too large; parentheses or a minus are negative, both positive."""
    number = F.regexp_replace(c, r"[^0-9.]", "").try_cast(AMOUNT)
    negative = c.rlike(r"\(") != c.contains("-")
    return F.when(c.rlike(MONEY), F.when(negative, -number).otherwise(number).cast(AMOUNT))


def format_money(value: Column, original: Column) -> Column:
    """Text of an amount, with thousands separators only if the original had one."""
    return F.when(F.instr(original, ",") > 0, F.format_number(value, 2)).otherwise(value.cast("string"))


def scale(value: Column, factor: str) -> Column:
    """A decimal amount times a factor (decimal text), rounded half up to cents; null where it outgrows decimal(18,2)."""
    return F.round(value.try_cast(AMOUNT) * F.lit(factor).cast("decimal(6,4)"), 2).try_cast(AMOUNT)


def scale_amount_text(c: Column, factor: str) -> Column:
    """Text amounts scaled; other text unchanged."""
    value = scale(parse_money(c), factor)
    return F.when(value.isNotNull(), format_money(value, c)).otherwise(c)


def is_date_like(c: Column) -> Column:
    return c.rlike(r"^\d{4}-\d{2}-\d{2}$|^\d{1,2}/\d{1,2}/\d{2,4}$")


def is_money_column(name: str, words: Sequence[str] = MONEY_WORDS) -> bool:
    return any(w in name.lower() for w in words)


def date_text(c: Column) -> Column:
    """``M/d/yyyy``, with the time of day if there is one."""
    return F.when(F.date_format(c, "HHmmss") == "000000", F.date_format(c, "M/d/yyyy")).otherwise(F.date_format(c, "M/d/yyyy HH:mm:ss"))


def number_text(c: Column) -> Column:
    """A double as text, whole numbers without a fraction."""
    return F.when(c == F.floor(c), F.floor(c).cast("bigint").cast("string")).otherwise(c.cast("string"))


def words(c: Column) -> Column:
    """Lower-case words of letters and digits; ``_`` separates."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))


def word_runs(tokens: Column, longest: int) -> Column:
    """Array of struct (at, run): at each word, from 1, the run of at most longest words that begins there."""
    return F.transform(tokens, lambda w, i: F.struct((i + 1).alias("at"), F.slice(tokens, i + 1, longest).alias("run")))


def ngrams(tokens: Column, longest: int) -> Column:
    """Array of struct (at, n, gram): every run of 1 to longest words, joined by one space. For short texts."""
    runs = lambda n: F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(1))), lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), F.array_join(F.slice(tokens, i, n), " ").alias("gram")))).otherwise(F.array().cast("array<struct<at:int,n:int,gram:string>>"))
    return F.concat(*(runs(n) for n in range(1, longest + 1)))


def clip(text: Column, at: Column, n: Column, around: int = 25) -> Column:
    """What surrounds the n words from word at (from 1) of a text, without line breaks or tabs."""
    parts = F.regexp_extract_all(text, F.lit(rf"[^\p{{L}}\p{{N}}]*{WORD}"), F.lit(0))
    upto = lambda k: F.length(F.array_join(F.slice(parts, F.lit(1), k), ""))
    word = F.length(F.regexp_extract(F.get(parts, at - 1), WORD, 0))
    start, end = upto(at) - word, upto(at + n - 1)
    first = F.greatest(start - around, F.lit(0))
    return F.translate(F.substr(text, first + 1, end - first + around), "\n\r\t", "   ")
