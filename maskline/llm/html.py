"""Main text of web pages by wrappers that are inferred per host.

A page becomes a well-formed stream of block tags and text. Adjacent repeats
are folded into ``( ... )+`` groups, which gives the page's expression. The
expressions of one host are aligned one after another: where they agree they
stay, where one has what the other lacks that part becomes ``( ... )?``, and a
lone unit next to a group of the same unit joins it. The result is a union-free
regular expression, the host's wrapper; every ``T`` in it is a text slot. Each
page is then matched against the wrapper of its host, which gives every text
its slot. The elements around a text are evidence for the label of its slot:
outside (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
reader comments), article (inside ``article`` or ``main``) or body. A body slot
is template text if its text is the same on all pages that have it and these
are three at least whose other body texts differ; copies of a page count once.

Extraction takes the article slots; on a page that has neither ``article`` nor
``main`` it takes the body slots that are not template text. A slot that an
optional element surrounds on some pages only is labelled for each case. A page
that its wrapper does not match loses no template text.

Work on a host is never gathered: expressions are made distinct, then aligned in
a tree: groups of about FAN by hash, then the groups' wrappers in groups again,
until a host has one, so the number of groups follows the host's expressions.
Pages meet their wrapper by join, and facts of slots are summed.

Defined results: null or empty html gives an empty text; a null or bare URL has
an empty host; unclosed tags close with their parent, stray end tags are
skipped, and a tag that never ends is text; repeated pages are extracted row by row; other
columns are ignored; an empty table gives an empty result. Nothing is cut off.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskline.llm import urls
from maskline.llm.stage import shared_dir, table, with_id, written

#: Elements without content, elements inside a line, elements whose start closes an open one of the same kind. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
RAW = frozenset("script style textarea title noscript iframe template svg xmp".split())
#: Elements that never hold the article, and words of class, id or role that mark such elements. Fixed values.
OUTSIDE = frozenset("head nav header footer aside form button select textarea menu dialog script style title noscript iframe template svg object canvas".split())
OUTSIDE_WORDS = frozenset(
    "ad ads banner breadcrumb copyright disclaimer footer header login menu modal nav navigation notice notices pager promo recommended related replies reply respond search share sharing signup skip social sponsor subscribe toolbar".split()
)
#: Words that mark such an element in any name; the others only beside numbers and PLAIN words, so that ``social-science`` or ``post-header`` stay. Fixed values.
STRONG = frozenset("adbox advert adverts advertisement advertising breadcrumbs comment comments consent cookie cookies disqus gdpr masthead navbar newsletter pagination popup promoted sidebar sponsored widget widgets".split())
PLAIN = frozenset("area bar block bottom box button buttons container form global group icons inner item items left link links list main outer page posts primary right row secondary section site top unit wrap wrapper".split())
WHOLE = frozenset("html body main".split())  # never outside because of their attributes
#: Expressions of a host that one step of the alignment takes in order.
FAN = 64
#: Longest unit, in tags and slots, that is folded; longer repeats stay as they are, which makes a wrapper longer but loses no text.
UNIT = 12

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+>)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
REPEAT = re.compile(r"((?:[^ ]+ ){1,%d}?)\1+" % UNIT)


def outside(tag: str, attributes: str) -> bool:
    if tag in OUTSIDE:
        return True
    if tag in WHOLE or not attributes:
        return False
    names = [[w for w in re.split(r"[^a-z]+", name) if w] for _, v in ATTRIBUTE.findall(attributes) for name in v.lower().split()]
    return any(not STRONG.isdisjoint(name) or (not OUTSIDE_WORDS.isdisjoint(name) and OUTSIDE_WORDS.union(PLAIN).issuperset(name)) for name in names)


def parse(page: str) -> tuple[list[str], list[tuple[str, str, bool, bool]]]:
    """(stream of ``+tag``, ``-tag`` and ``T``, slots (path, text, outside, in article)) of a page."""
    stream: list[str] = []
    slots: list[tuple[str, str, bool, bool]] = []
    stack: list[tuple[str, str, bool, bool]] = []  # tag, label, outside, in article
    line: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(line)).split())
        line.clear()
        if text:
            _, _, out, main = stack[-1] if stack else ("", "", False, False)
            stream.append("T")
            slots.append(("/".join(x[1] for x in stack), text, out, main))

    def close(k: int) -> None:
        flush()
        while len(stack) > k:
            stream.append("-" + stack.pop()[1])

    at = 0
    while True:
        m = TAG.search(page, at)
        line.append(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in INLINE:
            continue
        if m[1]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if k is not None:
                close(k)
            else:
                flush()
            continue
        flush()
        for names in (CLOSES.get(tag, ()), {"p"} if tag in ENDS_P else ()):
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in names), None)
            if k is not None and not any(x[0] in ("ul", "ol", "table", "div", "dl", "select") for x in stack[k + 1 :]):
                close(k)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        words = "".join(f".{v.strip('\"\'').replace(' ', '.')}" for _, v in ATTRIBUTE.findall(m[3])).lower()
        label = re.sub(r"[\s()/]+", "_", tag + words)
        out, main = stack[-1][2:] if stack else (False, False)
        stack.append((tag, label, out or outside(tag, m[3]), main or tag in ("article", "main") or bool(re.search(r"\brole\s*=\s*[\"']?main\b", m[3], re.I))))
        stream.append("+" + label)
    close(0)
    return stream, slots


def fold(stream: str) -> str:
    """Adjacent repeats as groups; the inner first, then repeats of what holds groups."""
    def group(m: re.Match) -> str:
        unit = m[1].split()
        depth = 0
        for w in unit:
            depth += (w == "(") - (w in (")+", ")?"))
            if depth < 0:
                return m[0]
        if depth:
            return m[0]
        return m[1] if len(nodes(m[1])) == 1 and unit[-1] == ")+" else f"( {m[1]})+ "

    while (folded := REPEAT.sub(group, stream)) != stream:  # each pass takes tags or groups away
        stream = folded
    return stream


def nodes(expression: str) -> list[str]:
    """Top-level parts: words and whole groups."""
    found, depth = [], 0
    for w in expression.split():
        if depth:
            found[-1] += f" {w}"
        else:
            found.append(w)
        depth += (w == "(") - (w in (")+", ")?"))
    return found


def accepts(wrapper: str, expression: str) -> bool:
    """True if the wrapper matches the streams that the expression stands for, with each group once and twice."""
    return all(_matches(wrapper, _sample(expression, n)) for n in (1, 2))


def _matches(wrapper: str, stream: str) -> bool:
    """Whether the wrapper matches a stream; all ways at once, so the time is bounded by the product of the lengths."""
    words, first = _program(wrapper)
    ways = set(first[0])
    for w in stream.split():
        ways = {k for at in ways if at < len(words) and words[at][0] == w for k in first[at + 1]}
        if not ways:
            return False
    return len(words) in ways


def _sample(expression: str, times: int) -> str:
    out = []
    for part in nodes(expression):
        if part.startswith("( "):
            inner = _sample(part[2:-3], times)
            out.append(inner * (times if part.endswith("+") else times - 1))
        else:
            out.append(part + " ")
    return "".join(out)


def align(a: str, b: str) -> str:
    """A union-free expression for what a or b stands for."""
    if a == b or accepts(a, b):
        return a
    for group in {n for n in nodes(a) + nodes(b) if n.endswith(")+")}:  # a lone unit is a group of one
        lone, whole = f" {group[2:-2]}", f" {group} "
        a, b = (re.sub(r"(?<!\()" + re.escape(lone), lambda _, w=whole: w, f" {x} ") if whole not in f" {x} " else x for x in (a, b))
    x, y, out = nodes(a), nodes(b), []
    bare = lambda n: n[2:-3].strip() if n.endswith(")?") else n
    for kind, i, j, k, m in SequenceMatcher(None, [bare(n) for n in x], [bare(n) for n in y], autojunk=False).get_opcodes():
        if kind == "equal":
            out += [p if p.endswith(")?") else q for p, q in zip(x[i:j], y[k:m], strict=True)]
        else:
            for part in (x[i:j], y[k:m]):
                if part:
                    out.append(part[0] if len(part) == 1 and part[0].endswith(")?") else f"( {' '.join(part)} )?")
    return " ".join(out)


def observe(pages: DataFrame) -> DataFrame:
    """(host, item, n) of pages (host, html): their expressions, distinct within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, str], int] = defaultdict(int)
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[host, fold(" ".join(parse(page or "")[0]) + " ").strip()] += 1
            columns = [pa.array([k[i] for k in found], pa.string()) for i in range(2)] + [pa.array(found.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "item", "n"])

    return pages.select("host", F.col("html").cast("string")).mapInArrow(run, "host string, item string, n long")


@lru_cache(maxsize=256)
def _program(wrapper: str) -> tuple[list[tuple[str, int]], list[tuple[int, ...]]]:
    """Words of a wrapper with the slot of each (0 for tags), and the words that may come first from each place; the last is the end."""
    words: list[tuple[str, int]] = []
    jumps: dict[int, tuple[int, ...]] = {}
    starts, slots = [], 0
    for w in wrapper.split():
        if w == "(":
            starts.append(len(words))
            words.append(("(", 0))
            jumps[starts[-1]] = (len(words),)
        elif w in (")+", ")?"):
            start = starts.pop()
            if w == ")+":
                jumps[len(words)] = (start + 1, len(words) + 1)
            else:
                jumps[len(words)] = (len(words) + 1,)
                jumps[start] = (start + 1, len(words))
            words.append((w, 0))
        else:
            slots += w == "T"
            words.append((w, slots if w == "T" else 0))
    first = []
    for k in range(len(words) + 1):
        seen, order, todo = set(), [], [k]
        while todo:
            at = todo.pop()
            if at not in seen:
                seen.add(at)
                if at in jumps:
                    todo += reversed(jumps[at])
                else:
                    order.append(at)
        first.append(tuple(order))
    return words, first


@lru_cache(maxsize=2048)
def places(wrapper: str, stream: str) -> tuple[int, ...] | None:
    """The wrapper's slot of each text of a stream, in order; None if the wrapper does not match it.

    All ways are followed side by side, so the time is bounded; groups go on as long as they can.
    """
    words, first = _program(wrapper)
    ways: dict[int, tuple | None] = dict.fromkeys(first[0])
    for w in stream.split():
        then: dict[int, tuple | None] = {}
        for at, path in ways.items():
            if at < len(words) and words[at][0] == w:
                path = (words[at][1], path) if w == "T" else path
                for k in first[at + 1]:
                    then.setdefault(k, path)
        ways = then
    if len(words) not in ways:
        return None
    path, out = ways[len(words)], []
    while path:
        out.append(path[0])
        path = path[1]
    return tuple(reversed(out))


def slotted(page: str | None, wrapper: str | None) -> tuple[bool, list[tuple[str | None, str, bool, bool]]]:
    """(whether the page has an article, its texts as (slot, text, outside, in article)); a slot is its number and the elements around it."""
    stream, slots = parse(page or "")
    at = places(wrapper or "", "".join(x + " " for x in stream)) or (None,) * len(slots)
    article = any(main for *_, main in slots) or any(x.partition(".")[0] in ("+article", "+main") for x in stream)
    return article, [(k and f"{k} {path}", text, out, main) for k, (path, text, out, main) in zip(at, slots, strict=True)]


def observe_slots(pages: DataFrame) -> DataFrame:
    """(host, content, slots) of pages (host, html, wrapper): the body texts of a page by slot, and one digest of them all; distinct within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, int], list[dict[str, str | int]]] = {}
            for host, page, wrapper in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                texts: dict[str, list[str]] = defaultdict(list)
                for slot, text, out, main in slotted(page, wrapper)[1]:
                    if slot and not out and not main:
                        texts[slot].append(text)
                if texts:
                    slots = [{"slot": slot, "hash": _digest(repr(t))} for slot, t in sorted(texts.items())]
                    found[host, _digest(repr(slots))] = slots
            columns = [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found.values(), pa.list_(pa.struct([("slot", pa.string()), ("hash", pa.int64())])))], names=["host", "content", "slots"])

    return pages.select("host", "html", "wrapper").mapInArrow(run, "host string, content long, slots array<struct<slot:string,hash:long>>")


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _align_streams(df: DataFrame, keys: list[str]) -> DataFrame:
    """One wrapper for each value of keys; expressions are aligned as they stream by, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, wrapper, n = None, "", 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array([own[0]], pa.string()), pa.array([wrapper], pa.string()), pa.array([n], pa.int64())], names=["host", "item", "n"])
        for batch in batches:
            rows = batch.to_pydict()
            for k in range(batch.num_rows):
                key = tuple(rows[c][k] for c in keys)
                if key != own:
                    if own is not None:
                        yield done()
                    own, wrapper, n = key, rows["item"][k], 0
                wrapper = align(wrapper, rows["item"][k])
                n += rows["n"][k]
        if own is not None:
            yield done()

    return df.repartition(*keys).sortWithinPartitions(*keys, F.desc("n"), "item").select(*keys, "item", "n").mapInArrow(run, "host string, item string, n long")


def wrappers(pages: DataFrame, folder: str) -> DataFrame:
    """(host, wrapper, n_pages, constants): constants are the slots of template text."""
    level = written(observe(pages).groupBy("host", "item").agg(F.sum("n").alias("n")), folder, "facts")
    depth = 0
    while True:
        sizes = level.groupBy("host").agg(F.count("*").alias("size"))
        salt = F.pmod(F.xxhash64("item"), F.ceil(F.col("size") / FAN).cast("int"))
        parts = level.join(sizes, "host").withColumn("salt", salt)
        level, depth = written(_align_streams(parts, ["host", "salt"]), folder, f"aligned-{depth}"), depth + 1
        if level.groupBy("host").count().where("count > 1").isEmpty():
            break
    whole = level.select("host", F.col("item").alias("wrapper"), F.col("n").alias("n_pages"))
    contents = observe_slots(pages.join(whole, "host")).dropDuplicates(["host", "content"])  # copies of a page are one
    slots = contents.select("host", F.inline("slots")).groupBy("host", "slot").agg(F.min("hash").alias("low"), F.max("hash").alias("high"), F.count("*").alias("n"))
    same = slots.where("low = high and n > 2").groupBy("host").agg(F.array_sort(F.collect_list("slot")).alias("constants"))  # slots of a wrapper
    return written(whole.join(same, "host", "left").select("host", "wrapper", "n_pages", F.coalesce("constants", F.array().cast("array<string>")).alias("constants")), folder, "wrappers")


def main_text(page: str | None, wrapper: str | None, constants: frozenset[str]) -> str:
    article, texts = slotted(page, wrapper)
    if article:
        return " ".join(text for _, text, out, main in texts if main and not out)
    return " ".join(text for slot, text, out, _ in texts if not out and slot not in constants)


def extract(pages: DataFrame, id_col: str = "page_id", folder: str | None = None) -> DataFrame:
    """(id, url, text, wrapper) for each row of pages (id, url, html)."""
    folder = folder or shared_dir(pages.sparkSession)
    rows = pages.select(F.col(id_col), "url", F.col("html").cast("string").alias("html"), urls.host(F.col("url")).alias("host"))
    both = rows.join(wrappers(rows, folder), "host", "left").select(id_col, "html", "constants", "url", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, wrapper, frozenset(constants or ())) for page, constants, wrapper in zip(*(batch.column(k).to_pylist() for k in (1, 2, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(texts, pa.string()), batch.column(4)], names=[id_col, "url", "text", "wrapper"])

    return both.mapInArrow(run, with_id(both, id_col, "url string, text string, wrapper string"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages -> page_id, url, text, n_chars."""
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {"op4_html_extraction": op4_html_extraction}
ORACLES: dict[str, str] = {}
