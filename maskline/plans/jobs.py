"""The three jobs: a ledger with its rules, new statements under a saved mapping, and related tables.

Each returns its masked tables, the mapping, and a report that checks the run.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskline.functions import text as t
from maskline.operators import checks as c
from maskline.operators import identifiers as ids
from maskline.operators import mapping as m
from maskline.operators import masking as k
from maskline.operators import related as rel
from maskline.operators import rows as r
from maskline.shared import shared_dir, written
from maskline.sources.files import role, write_outputs


@dataclass
class Options:
    """seed (minted if none is given) and choices of a run; digits is the length of fake account numbers. Pools follow the counted data.

    factor, as decimal text from 0.80 to 1.20, scales every amount; each run's report then has the totals.
    """

    seed: str = field(default_factory=m.new_seed)
    digits: int = 5
    factor: str | None = None

    def __post_init__(self) -> None:
        if self.factor is not None and not Decimal("0.80") <= Decimal(self.factor) <= Decimal("1.20"):
            raise ValueError("the factor must lie between 0.80 and 1.20")


def candidates(wanted: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Pools for reals (kind) without any forbidden value (column value) or word, as large as the counts ask for."""
    n_forbidden, bad, out = forbidden.count(), written(m.in_pools(forbidden), shared_dir(forbidden.sparkSession), "forbidden"), None
    for x in wanted.groupBy("kind").agg(F.count("*").alias("n")).orderBy("kind").collect():  # four kinds at most
        part = m.pool(wanted.sparkSession, x.kind, m.pool_size(x.kind, x.n, n_forbidden))
        out = part if out is None else out.union(part)
    out = out if out is not None else m.pool(wanted.sparkSession, "single", 0)
    return out if bad.isEmpty() else m.allowed(out, bad)


def term_reals(terms: DataFrame) -> DataFrame:
    """(category, kind, real): one spelling of each listed name and town; spellings with the same words are one."""
    listed = terms.where("category in ('Names', 'Towns')").withColumn("_w", t.words(F.col("term"))).where(F.size("_w") > 0)
    one = listed.groupBy("category", F.array_join("_w", " ").alias("key")).agg(F.min("term").alias("real"), F.any_value(F.size("_w")).alias("n"))
    town = F.col("category") == "Towns"
    kind = F.when(town, "town").when(F.col("n") > 1, "person").otherwise("single")
    return one.select(F.when(town, "town").otherwise("name").alias("category"), kind.alias("kind"), "real")


def with_suffix(fake: str, suffix: str) -> Column:
    return F.concat(F.col(fake), F.when(F.col(suffix) != "", F.concat(F.lit(" "), F.col(suffix))).otherwise(""))


def row(df: DataFrame, category: str, real: str, fake: str) -> DataFrame:
    return df.select(F.lit(category).alias("category"), F.col(real).alias("real"), F.col(fake).alias("fake"))


def number_terms(forms: DataFrame, accounts: DataFrame) -> DataFrame:
    """(category, real, fake): forms (account_num) with letters and digits, and the bare last four of accounts (key, fake_last4, fake_number)."""
    mixed = forms.where("account_num rlike '[A-Za-z]' and account_num rlike '[0-9]'").withColumn("key", t.account_key(F.col("account_num"))).distinct()
    bare = accounts.withColumn("bare", t.bare_form(F.col("key"))).where("bare is not null")
    return row(mixed.join(accounts, "key"), "acctnum", "account_num", "fake_number").union(row(bare, "last4", "bare", "fake_last4"))


def build_mapping(records: DataFrame, terms: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """(mapping (category, real, fake), accounts (key, fake_last4, fake_number, institution)) of pooled records."""
    folder = shared_dir(records.sparkSession)
    records = written(records.hint("rebalance"), folder, "records")  # read by each part
    names = records.where("account <> ''").select(F.col("account").alias("real")).distinct()
    parts = names.withColumn("x", t.split_core(F.col("real"))).select("real", F.lower("x.core").alias("root"), F.col("x.suffix").alias("suffix"))
    forbidden = written(terms.select(F.col("term").alias("value")).union(names).distinct(), folder, "forbidden")
    roots = parts.select(F.lit("root").alias("category"), F.lit("person").alias("kind"), F.col("root").alias("real")).distinct()
    wanted = written(term_reals(terms).union(roots), folder, "wanted")
    drawn = written(m.assign(wanted, candidates(wanted, forbidden), options.seed), folder, "drawn")
    own = parts.join(drawn.where("category = 'root'").select(F.col("real").alias("root"), "fake"), "root").select("real", with_suffix("fake", "suffix").alias("fake"))
    keys = ids.keyed(records).select("key").distinct()
    accounts = m.numbers(keys, options.seed, options.digits).join(ids.canonical_institutions(records), "key", "left")
    accounts = written(accounts, folder, "accounts")
    runs = m.salted_unique(records.select(F.explode(t.digit_runs(F.col("description"))).alias("real")), options.seed, "run", accounts.select(F.col("fake_last4").alias("fake")), widen=True)
    whole = (
        row(own, "account_name", "real", "fake").union(drawn.where("category <> 'root'").select("category", "real", "fake"))
        .union(number_terms(records.select("account_num"), accounts)).union(row(runs, "run", "real", "fake"))
    )
    return written(whole, folder, "mapping"), accounts


def identities(mapping: DataFrame, accounts: DataFrame) -> DataFrame:
    """(category, real, fake) of things, not of spellings: accounts by key, names by their words."""
    spelled = mapping.where("category not in ('acctnum', 'last4')").select("category", F.array_join(t.words(F.col("real")), " ").alias("real"), "fake")
    return spelled.union(accounts.select(F.lit("acctnum"), "key", "fake_number"))


def mapping_sizes(mapping: DataFrame, accounts: DataFrame, records: DataFrame) -> DataFrame:
    """(category, n): reals of each category, accounts, and accounts whose records name several institutions."""
    count = lambda df, name: df.agg(F.lit(name).alias("category"), F.count("*").alias("n"))
    return mapping.groupBy("category").agg(F.count("*").alias("n")).union(count(accounts, "accounts")).union(count(ids.institution_conflicts(records), "accounts in conflict"))


def passed(bad: DataFrame) -> DataFrame:
    """One row: whether a table of faults is empty."""
    return bad.agg((F.count("*") == 0).alias("passed"))


def ledger_job(ledger: DataFrame, rules: DataFrame, terms: DataFrame, options: Options, id_col: str = "seq", out: str | None = None) -> dict[str, DataFrame]:
    """Masked ledger and rules, the mapping, the accounts, all replacements (spans), unmapped runs, the leaks that are left, the hit counts, and the report of all checks.

    Every check is made over both tables; the report has a row for each table where they differ in kind. With out, the
    tables are published under the seed if all checks pass, else kept apart.
    """
    folder = shared_dir(ledger.sparkSession)
    build = lambda a, b: build_mapping(r.pooled([a], [b]), terms, options)
    mapping, accounts = build(ledger, rules)
    named = lambda df, name: r.project(df).withColumn("table", F.lit(name))
    whole = named(ledger, "ledger").union(named(rules, "rules")).withColumn("place", F.concat_ws(":", "table", id_col))
    source = written(whole.hint("rebalance"), folder, "source")  # masking and scans take as long as their largest task
    texts = ["description", "account"]
    both = written(k.mask_ledger(source, mapping, accounts, options.seed, options.factor, hits=True), folder, "masked")
    masked, spans = both.select(*source.columns), k.spans(both, ["table", id_col], texts)
    number = accounts.where("key rlike '^[0-9]+$'").select(t.bare_form(F.col("key")).alias("term"))
    scan = written(c.leak_terms(terms, source.where("account <> ''").select(F.col("account").alias("term")), number), folder, "scan")
    leaks = lambda df: c.leak_scan(df, "place", texts, scan)
    left = written(leaks(masked), folder, "leaks")
    mode = F.when(F.col("category") == "run", "exact").when(F.col("category") == "last4", "drop").otherwise("info")
    counted = mapping.where("category in ('run', 'last4', 'account_name')").select(F.col("category").alias("rule"), mode.alias("mode"), "real", "fake")
    hits = written(c.hit_counts(source, masked, texts, counted), folder, "hits")
    kept = ["date"] if options.factor else ["date", "amount"]
    checks = {"leaks": c.leak_gate(leaks(source), left), "hit counts": passed(hits.where("not passed")), "one to one": passed(c.bijection(identities(mapping, accounts)))}
    for name in ("ledger", "rules"):
        own = lambda df, name=name: df.where(F.col("table") == name)
        checks[f"untouched columns of {name}"] = passed(c.integrity(own(source), own(masked), id_col, kept))
        if options.factor:
            amounts = lambda df: own(df).select(t.parse_money(F.col("amount")).alias("amount"))  # noqa: E731, B023
            checks[f"totals of {name}"] = c.amount_tieout(amounts(source), amounts(masked), "amount", options.factor)
    checks["determinism"] = c.determinism(mapping, build(ledger.repartition(3), rules)[0])
    report = written(c.report(checks), folder, "report")
    done = {name: masked.where(F.col("table") == name).select(*r.LEDGER) for name in ("ledger", "rules")}
    more = {"mapping": mapping, "accounts": accounts, "spans": spans, "stats": k.replacement_counts(spans), "unmapped": k.unmapped_runs(spans, mapping), "leaks": left, "hits": hits, "report": report, "sizes": mapping_sizes(mapping, accounts, r.pooled([ledger], [rules]))}
    if out:
        publish(done, report, out, options.seed)
    return done | more


def publish(tables: dict[str, DataFrame], report: DataFrame, out: str, seed: str) -> None:
    """The tables of a run under its seed if its report passed, else in quarantine."""
    failed = [x.check for x in report.where("not passed").collect()]
    write_outputs(tables | {"report": report}, out, seed, not failed, ", ".join(failed))


def statements_job(rows: DataFrame, mapping: DataFrame, seed: str, factor: str | None = None, forbidden: DataFrame | None = None) -> dict[str, DataFrame]:
    """New statement rows (file, row_no, cells) under a saved mapping: only runs that it lacks are added (runs); names and towns are not.

    The report tells whether names and numbers of the mapping, or forbidden terms (category, term), are left in any cell
    that is masked; new files need not hold any.
    """
    folder = shared_dir(rows.sparkSession)
    headers = written(r.statement_headers(rows), folder, "headers")
    found = rows.select(F.explode(t.digit_runs(F.array_join("cells", " "))).alias("real")).distinct()
    known = mapping.where("category = 'run'").select("real", "fake")
    whole = written(m.extend(known, found, seed, "run", widen=True), folder, "runs").select(F.lit("run").alias("category"), "real", "fake")
    extended = mapping.where("category <> 'run'").select("category", "real", "fake").union(whole)
    masked = written(k.mask_statements(rows, headers, extended, seed, factor), folder, "masked")
    terms = extended.where("category not in ('run', 'code')").select("category", F.col("real").alias("term"))
    terms = terms if forbidden is None else terms.union(forbidden.select("category", "term"))
    leaks = written(c.leak_scan(described(masked, headers), "place", ["text"], terms), folder, "leaks")
    return {"rows": masked, "mapping": extended, "runs": whole.join(known, "real", "left_anti").select("category", "real", "fake"), "leaks": leaks, "report": c.report({"leaks": passed(leaks)})}


def described(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """(place, text) of statement rows: their description cells, and the preamble."""
    names = headers.join(rows, "file").where("row_no = header_row").select("file", F.array_position(F.transform("cells", lambda x: F.lower(t.clean(x))), "description").alias("_at"))
    parts = r.sections(rows, headers).join(names, "file")
    text = F.when(F.col("section") == "preamble", F.array_join("cells", "\n")).when((F.col("section") == "data") & (F.col("_at") > 0), F.try_element_at("cells", F.col("_at").cast("int")))
    return parts.select(F.concat_ws(":", "file", "row_no").alias("place"), text.alias("text")).where("text is not null")


def build_related(tables: dict[str, DataFrame], terms: DataFrame, options: Options) -> dict[str, DataFrame]:
    """mapping (category, real, fake), accounts (key, fake_last4, fake_number) and addresses (real, fake_street, fake) of related tables.

    One of them must be the key table (address, prop, llc); otherwise this is an error, since addresses would stay.
    """
    role(tables, rel.KEY_TABLE)
    seed, folder = options.seed, shared_dir(terms.sparkSession)
    found = written(rel.harvest(tables), folder, "harvest")
    of = lambda category: found.where(F.col("category") == category).select("value")
    linked = {x: written(rel.least_addresses(tables, x), folder, f"least-{x}") for x in ("prop", "llc")}
    parts = written(rel.address_parts(of("address").withColumnRenamed("value", "address")), folder, "parts")
    names = written(rel.name_roots(terms.where("category = 'Names'").select("term")), folder, "names")
    real = lambda df, kind, c: df.select(F.lit(kind).alias("category"), F.lit(kind).alias("kind"), c.alias("real")).where("real <> ''")
    towns = real(terms.where("category = 'Towns'"), "town", F.lower(t.clean(F.col("term")))).union(real(parts, "town", F.lower("city")))
    wanted = towns.union(real(parts, "street", F.lower("street"))).union(names.select(F.lit("root").alias("category"), "kind", F.col("root").alias("real"))).distinct()
    wanted = written(wanted, folder, "wanted")
    forbidden = written(terms.select(F.col("term").alias("value")).union(found.where("category in ('account_name', 'llc', 'address')").select("value")).distinct(), folder, "forbidden")
    drawn = written(m.assign(wanted, candidates(wanted, forbidden), seed), folder, "drawn")
    at = lambda category: drawn.where(F.col("category") == category).select("real", "fake")
    addresses = written(rel.address_map(parts, at("street"), at("town")), folder, "addresses")
    keys = of("account_num").select(F.col("value").alias("account_num"))
    accounts = written(m.numbers(keys.select(t.account_key(F.col("account_num")).alias("key")), seed, options.digits), folder, "accounts")
    used = found.select(F.col("value").alias("fake"))
    entities = written(m.salted_unique(of("entity").withColumnRenamed("value", "real"), seed, "entity", used, widen=True, forbidden=forbidden).select("real", "fake"), folder, "entities")
    props = rel.property_codes(of("property"), linked["prop"], addresses, used.union(entities.select("fake")).distinct(), seed, f"{folder}/prop-rounds", forbidden)
    llcs = written(rel.llc_names(linked["llc"], addresses, used, seed, f"{folder}/llc-rounds"), folder, "llcs")
    listed = names.join(at("root").withColumnRenamed("real", "root"), "root").select("real", with_suffix("fake", "suffix").alias("fake"))
    mapping = (
        row(at("street"), "street", "real", "fake").union(row(llcs, "llc", "real", "fake")).union(row(rel.root_override(listed, llcs), "name", "real", "fake"))
        .union(row(at("town"), "town", "real", "fake")).union(row(props, "propcode", "real", "fake")).union(row(entities, "entcode", "real", "fake")).union(number_terms(keys, accounts))
    )
    return {"mapping": written(mapping, folder, "mapping"), "accounts": accounts, "addresses": addresses, "harvest": found}


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]


def glued_terms(tables: dict[str, DataFrame], mapping: DataFrame) -> DataFrame:
    """(category, real, fake) of words in any table that are two known one-word names without a space."""
    words = None
    for df in tables.values():
        for name in text_columns(df):
            part = df.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(f"`{name}`"), F.lit(""))), F.lit(r"\p{L}{6,}"), F.lit(0)))).alias("word")).distinct()
            words = part if words is None else words.union(part)
    return row(k.glued_names(words.distinct(), mapping.where("category = 'name'")), "glued", "word", "fake")


def related_tables_job(tables: dict[str, DataFrame], terms: DataFrame, options: Options, statements: DataFrame | None = None, out_path: str | None = None) -> dict[str, DataFrame | dict[str, DataFrame]]:
    """All tables, and statement rows (file, row_no, cells), under one mapping; same columns, and joins on masked keys still hold.

    The report has the blacklist scan of all that comes out (and that it finds something in what goes in), determinism,
    one-to-one fakes, the joins of tables that share Prop or LLC, and the totals of scaled decimal columns. With out_path,
    all tables are published there at once under the seed if all checks pass, else kept apart.
    """
    folder = shared_dir(terms.sparkSession)
    cells = lambda df: df.select(F.array_join("cells", "\n", "").alias("text"))
    rows = {} if statements is None else {"statements": cells(statements)}
    built = build_related(tables, terms, options)
    mapping = written(built["mapping"].union(glued_terms(tables | rows, built["mapping"])), folder, "mapping")
    mask = lambda df: k.mask_table(df, mapping, built["accounts"], options.seed, options.factor, built["addresses"])
    masked = {name: written(mask(df), f"{folder}/out", name) for name, df in tables.items()}
    out = dict(masked)
    if statements is not None:
        headers = written(r.statement_headers(statements), folder, "headers")
        out["statements"] = written(k.mask_statements(statements, headers, mapping, options.seed, options.factor), f"{folder}/out", "statements")
    black = terms.where("category = 'Blacklist'").select("category", "term")
    after = masked | ({"statements": cells(out["statements"])} if statements is not None else {})
    leaks = written(scan(after, black), folder, "leaks")
    again = build_related({name: df.repartition(3) for name, df in tables.items()}, terms, options)["mapping"]
    checks: dict[str, DataFrame] = {
        "blacklist": c.leak_gate(scan(tables | rows, black), leaks), "determinism": c.determinism(built["mapping"], again), "one to one": passed(c.bijection(one_to_one(built["mapping"], built["accounts"]))),
    }
    for on in ("prop", "llc"):
        have = [n for n, df in sorted(tables.items()) if r.has_columns(df, [on])]
        for a, b in combinations(have, 2):
            keyed = lambda side, on=on: [side[n].select(F.lower(r.column_of(side[n], on)).alias(on)).where(f"{on} <> ''") for n in (a, b)]  # noqa: E731, B023
            checks[f"join of {a} and {b} on {on}"] = c.join_preservation(keyed(tables), keyed(masked), on)
    for name, df in tables.items() if options.factor else ():
        for f in df.schema.fields:
            if f.dataType.typeName() == "decimal" and t.is_money_column(f.name):
                checks[f"totals of {name}.{f.name}"] = c.amount_tieout(df, masked[name], f.name, options.factor)
    report = c.report(checks)
    if out_path:
        report = written(report, folder, "report")
        publish(out, report, out_path, options.seed)
    return {"tables": out, "mapping": mapping, "accounts": built["accounts"], "addresses": built["addresses"], "leaks": leaks, "report": report}


def scan(tables: dict[str, DataFrame], terms: DataFrame) -> DataFrame:
    """Blacklist terms in the text columns of all tables, by the number of the row."""
    numbered: dict[str, tuple[DataFrame, str, list[str]]] = {n: (df.withColumn("_n", F.monotonically_increasing_id()), "_n", text_columns(df)) for n, df in tables.items()}
    return c.blacklist_scan({n: x for n, x in numbered.items() if x[2]}, terms)


def one_to_one(mapping: DataFrame, accounts: DataFrame) -> DataFrame:
    """The identities of a related mapping; roots that take their company's fake are that company."""
    own = mapping.where("category = 'llc'").select(F.lower(t.split_core(F.col("real"))["core"]).alias("real"), F.lit("name").alias("category"))
    return identities(mapping.join(own.distinct(), ["category", "real"], "left_anti").select("category", "real", "fake"), accounts)

