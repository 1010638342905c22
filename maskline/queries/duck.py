"""Pieces of oracle SQL (DuckDB dialect), the counterparts of the column functions."""

from __future__ import annotations

from maskline.operators import mapping as m

SEED = "seed-1"
#: What the rules accept, written out here so that the oracle does not follow the library. Fixed values.
SUFFIXES = "CK CHK CHECKING CHECK SAVINGS SAV SV LLC INC CORP CO TRUST MGMT HOLDINGS OPS FUND ESCROW BUS BUSINESS BIZ VISA CARD CC LOAN PAYPAL CREDIT".split()
MONEY_WORDS = "amount balance deposit building land depreciation mortgage cash rent value price cost fee income expense".split()
MONEY_NAMES = ["amount", "running bal.", "running balance", "balance", "summary amt."]


def clean(x: str) -> str:
    return rf"regexp_replace(regexp_replace(coalesce(CAST({x} AS VARCHAR), ''), '^\s+', ''), '\s+$', '')"


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def key(x: str) -> str:
    return f"CASE WHEN {digits(x)} <> '' THEN CAST(CAST(right({digits(x)}, 4) AS INTEGER) AS VARCHAR) ELSE upper(trim({x})) END"


def runs(x: str) -> str:
    return rf"regexp_extract_all({x}, '\d{{5,}}')"


def is_code(x: str) -> str:
    return f"(length({x}) >= 5 AND regexp_matches({x}, '[A-Za-z]') AND length({digits(x)}) >= 2)"


def codes(x: str) -> str:
    return f"list_filter(regexp_extract_all({x}, '[A-Za-z0-9]+'), lambda t: {is_code('t')})"


def shape(x: str, category: str, salt: str = "0", i: str = "i") -> str:
    n = f"CAST('0x' || substr(sha256(concat_ws('|', '{SEED}', '{category}', {x}, '{salt}', CAST({i} AS VARCHAR))), 1, 8) AS BIGINT)"
    c = f"substr({x}, {i}, 1)"
    pick = lambda base, size: f"chr(CAST({base} + {n} % {size} AS INTEGER))"
    return (
        f"array_to_string(list_transform(range(1, length({x}) + 1), lambda {i}: CASE WHEN regexp_matches({c}, '[0-9]') THEN {pick(48, 10)} "
        f"WHEN regexp_matches({c}, '[A-Z]') THEN {pick(65, 26)} WHEN regexp_matches({c}, '[a-z]') THEN {pick(97, 26)} ELSE {c} END), '')"
    )


def blanket(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '^[0-9]{{5,}}$') THEN {shape(x, 'run')} WHEN regexp_matches({x}, '^[A-Za-z0-9]+$') AND {is_code(x)} THEN {shape(x, 'code')} ELSE {x} END"


def scrub(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '[A-Za-z0-9]{{5}}') AND regexp_matches({x}, '[0-9]') THEN array_to_string(list_transform(regexp_extract_all({x}, '[A-Za-z0-9]+|[^A-Za-z0-9]+'), lambda t: {blanket('t')}), '') ELSE {x} END"


def money(x: str) -> str:
    number = f"TRY_CAST(regexp_replace({x}, '[^0-9.]', '', 'g') AS DECIMAL(18,2))"
    plain, dashed = rf"regexp_matches(trim({x}), '^-?[$]?[0-9,]+[.][0-9][0-9]$')", rf"regexp_matches(trim({x}), '^[$]-[0-9,]+[.][0-9][0-9]$')"
    inside = rf"regexp_matches(trim({x}), '^[(]-?[$]?[0-9,]+[.][0-9][0-9][)]$')"
    return f"CASE WHEN {inside} THEN CASE WHEN contains({x}, '-') THEN {number} ELSE -{number} END WHEN {plain} OR {dashed} THEN CASE WHEN contains({x}, '-') THEN -{number} ELSE {number} END END"


def scaled(x: str, factor: str) -> str:
    return f"TRY_CAST(round({x} * CAST('{factor}' AS DECIMAL(6,4)), 2) AS DECIMAL(18,2))"


def scaled_text(x: str, factor: str) -> str:
    v = scaled(f"({money(x)})", factor)
    return f"CASE WHEN ({money(x)}) IS NOT NULL THEN CASE WHEN contains({x}, ',') THEN format('{{:,.2f}}', {v}) ELSE CAST({v} AS VARCHAR) END ELSE {x} END"


def core(x: str) -> str:
    """Struct-free pair: (core, suffix) SQL of an account name."""
    w = rf"regexp_split_to_array(trim({x}), '\s+')"
    words = ", ".join(f"'{s}'" for s in SUFFIXES)
    cut = f"(len({w}) > 1 AND upper(regexp_replace({w}[-1], '^[.,]+|[.,]+$', '', 'g')) IN ({words}))"
    return f"CASE WHEN {cut} THEN array_to_string({w}[1:len({w}) - 1], ' ') ELSE array_to_string({w}, ' ') END", f"CASE WHEN {cut} THEN {w}[-1] ELSE '' END"


def words(x: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{N}}]+')"


def gram(x: str) -> str:
    return f"array_to_string({words(x)}, ' ')"


def grams(w: str) -> str:
    """List of {at, n, gram} of the list w, up to three words."""
    parts = []
    for n in (1, 2, 3):
        joined = " || ' ' || ".join(f"{w}[i + {k}]" if k else f"{w}[i]" for k in range(n))
        parts.append(f"list_transform(range(1, greatest(len({w}) + {2 - n}, 1)), lambda i: {{'at': i, 'n': {n}, 'gram': {joined}}})")
    return f"list_concat(list_concat({parts[0]}, {parts[1]}), {parts[2]})"


def literal(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def invented(i: str) -> str:
    a, b = len(m.STARTS), len(m.MIDDLES)
    return f"({literal(m.STARTS)}[({i}) % {a} + 1] || {literal(m.MIDDLES)}[(({i}) // {a}) % {b} + 1] || {literal(m.ENDS)}[(({i}) // {a * b}) % {len(m.ENDS)} + 1])"


def pool(kind: str, size: str) -> str:
    """size: SQL of a whole number. Past the product of its parts a value gets one more word."""
    n = m.POOL_WORDS
    most = {"single": n, "person": n * n, "town": 4 * n, "street": 999 * n * 4}[kind]
    value = {
        "single": invented(f"i % {n}"),
        "person": f"{invented(f'i % {n}')} || ' ' || {invented(f'(i * 7919 + i // {n}) % {n}')}",
        "town": f"{invented(f'i % {n}')} || ' ' || ['Falls', 'Heights', 'Grove', 'Harbor'][(i // {n}) % 4 + 1]",
        "street": f"CAST(i % 999 + 1 AS VARCHAR) || ' ' || {invented(f'(i // 999) % {n}')} || ' ' || {literal(m.STREET_KINDS)}[(i // {999 * n}) % 4 + 1]",
    }[kind]
    word = f"lower({invented('more - 1')})" if kind == "single" else f"' ' || {invented('more - 1')}"
    return f"SELECT '{kind}' AS kind, {value} || CASE WHEN more > 0 THEN {word} ELSE '' END AS value FROM (SELECT j % {most} AS i, j // {most} AS more FROM (SELECT unnest(range(CAST({size} AS BIGINT))) AS j))"


def pool_size(kind: str, reals: str, forbidden: str) -> str:
    """reals and forbidden: SQL of counts."""
    return f"greatest({m.LEAST_POOL[kind]}, 3 * (({reals}) + ({forbidden})))"


def hashed(category: str, value: str) -> str:
    return f"sha256(concat_ws('|', '{SEED}', {category}, {value}))"


def allowed(candidates: str, forbidden: str) -> str:
    """SQL over CTE names: candidates (kind, value), forbidden (value)."""
    return f"""SELECT kind, value FROM {candidates} c WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT kind, value FROM (SELECT kind, value, unnest({grams(words('value'))}).gram AS g FROM {candidates})
 WHERE g IN (SELECT {gram('value')} FROM {forbidden})) h WHERE h.kind = c.kind AND h.value = c.value)"""


def assigned(reals: str, candidates: str) -> str:
    return f"""SELECT a.category, a.kind, a.real, b.value AS fake FROM
 (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY {hashed('kind', "concat_ws('|', category, real)")}) AS r FROM (SELECT DISTINCT category, kind, real FROM {reals})) a
 JOIN (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY {hashed("'pool-' || kind", 'value')}) AS r FROM {candidates}) b ON a.kind = b.kind AND a.r = b.r"""


def _choices(c: str) -> str:
    return f"(CASE {c} WHEN '0' THEN 10 WHEN 'A' THEN 26 WHEN 'a' THEN 26 ELSE 1 END)"


def shape_of(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({x}, '[0-9]', '0', 'g'), '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g')"


def room(x: str) -> str:
    return f"list_aggregate(list_transform(range(1, length({x}) + 1), lambda k: {_choices(f'substr({x}, k, 1)')}), 'product')"


def nth(x: str, i: str) -> str:
    """The i-th value of a shape: each character by the product of the choices to its right."""
    c = f"substr({x}, k, 1)"
    right = f"CAST(coalesce(list_aggregate(list_transform(range(k + 1, length({x}) + 1), lambda j: {_choices(f'substr({x}, j, 1)')}), 'product'), 1) AS BIGINT)"
    return f"array_to_string(list_transform(range(1, length({x}) + 1), lambda k: CASE WHEN {c} IN ('0', 'A', 'a') THEN chr(CAST(ascii({c}) + ({i} // {right}) % {_choices(c)} AS INTEGER)) ELSE {c} END), '')"


def numbers(keys: str, digits: int) -> str:
    """SQL of (key, fake_last4, fake_number) of CTE keys (key)."""
    return f"""SELECT a.key, b.value AS fake_last4, 'xxxx' || b.value AS fake_number FROM (SELECT key, row_number() OVER (ORDER BY {hashed("'last4'", 'key')}) AS r FROM {keys}) a
 JOIN (SELECT value, row_number() OVER (ORDER BY {hashed("'pool-last4'", 'value')}) AS r FROM (SELECT lpad(CAST(i AS VARCHAR), {digits}, '0') AS value FROM range({10**digits}) t(i))
 WHERE value NOT IN (SELECT lpad(key, 4, '0') FROM {keys} WHERE regexp_matches(key, '^[0-9]+$'))) b ON a.r = b.r"""


def keyed(category: str, value: str, *parts: str) -> str:
    rest = ", ".join(f"'{p}'" for p in parts)
    return f"CAST('0x' || substr(sha256(concat_ws('|', '{SEED}', '{category}', {value}, {rest})), 1, 8) AS BIGINT)"


def draws(name: str, reals: str, first: str, again, taken: str, rounds: int = 4) -> str:
    """CTEs of rounds of draws and <name> (real, fake): column first of CTE reals (real, ...), then again(salt); of equal ones the least real wins."""
    out, placed = [], []
    for k in range(rounds):
        before = "".join(f" UNION ALL SELECT fake FROM {p}" for p in placed)
        gone = "".join(f" AND real NOT IN (SELECT real FROM {p})" for p in placed)
        out.append(f"{name}_{k} AS MATERIALIZED (SELECT min(real) AS real, fake FROM (SELECT real, {again(str(k)) if k else first} AS fake FROM {reals} WHERE true{gone}) WHERE fake NOT IN (SELECT fake FROM {taken}{before}) GROUP BY fake)")
        placed.append(f"{name}_{k}")
    return ", ".join([*out, f"{name} AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT real, fake FROM {p}" for p in placed) + ")"])


def salted(name: str, reals: str, category: str, rounds: int, taken: str | None = None, widen: int = 2) -> str:
    """CTEs of rounds of salted fakes for CTE reals (real), then of fakes by rank among the free values of a shape, and <name> (real, fake, salt); taken has a column fake."""
    used = f"SELECT real AS fake FROM {reals}" + (f" UNION SELECT fake FROM {taken}" if taken else "")
    out, placed = [], []
    for k in range(rounds):
        before = "".join(f" UNION ALL SELECT fake FROM {p}" for p in placed)
        gone = "".join(f" AND real NOT IN (SELECT real FROM {p})" for p in placed)
        out.append(f"""{name}_{k} AS MATERIALIZED (SELECT min(real) AS real, fake, {k} AS salt FROM (SELECT real, {shape('real', category, str(k))} AS fake FROM (SELECT DISTINCT real FROM {reals}) WHERE true{gone})
 WHERE fake NOT IN ({used}{before}) GROUP BY fake)""")
        placed.append(f"{name}_{k}")
    won = " UNION ALL ".join(f"SELECT real, fake FROM {p}" for p in placed)
    out.append(f"{name}_l0 AS MATERIALIZED (SELECT DISTINCT real, {shape_of('real')} AS shape FROM {reals} WHERE real NOT IN (SELECT real FROM ({won})))")
    out.append(f"{name}_t0 AS MATERIALIZED ({used} UNION SELECT fake FROM ({won}))")
    by_hash = lambda kind, x: f"row_number() OVER (PARTITION BY shape ORDER BY {hashed(repr(f'{kind}-{category}'), x)}) AS r"
    for k in range(widen):
        out.append(f"""{name}_f{k} AS MATERIALIZED (SELECT shape, fake, {by_hash('free', 'fake')} FROM (SELECT shape, {nth('shape', 'i')} AS fake FROM (SELECT shape, unnest(range(CAST(least({room('shape')}, n + coalesce(m, 0)) AS BIGINT))) AS i
 FROM (SELECT shape, count(*) AS n FROM {name}_l{k} GROUP BY shape) LEFT JOIN (SELECT {shape_of('fake')} AS shape, count(*) AS m FROM {name}_t{k} GROUP BY 1) USING (shape))) WHERE fake NOT IN (SELECT fake FROM {name}_t{k})),
 {name}_w{k} AS MATERIALIZED (SELECT a.real, a.shape, b.fake FROM (SELECT real, shape, {by_hash('left', 'real')} FROM {name}_l{k}) a LEFT JOIN {name}_f{k} b ON a.shape = b.shape AND a.r = b.r),
 {name}_l{k + 1} AS (SELECT real, shape || '0' AS shape FROM {name}_w{k} WHERE fake IS NULL), {name}_t{k + 1} AS (SELECT fake FROM {name}_t{k} UNION SELECT fake FROM {name}_w{k} WHERE fake IS NOT NULL)""")
    late = "".join(f" UNION ALL SELECT real, fake, {rounds} FROM {name}_w{k} WHERE fake IS NOT NULL" for k in range(widen))
    out.append(f"{name} AS (" + " UNION ALL ".join(f"SELECT real, fake, salt FROM {p}" for p in placed) + late + ")")
    return ", ".join(out)


def masked(source: str, key: str, columns: dict[str, str], terms: str, order: tuple[str, ...], name: str = "walked", blanket_rule: bool = True) -> str:
    """CTEs that end in <name> (id, col, text, n_hits): the columns masked with CTE terms (category, real, fake), word by word from the left.

    The terms that stand at each word are found by their words; the walk takes the best at each place and goes on behind it.
    The columns are text that is not null.
    """
    ranks = " ".join(f"WHEN '{x}' THEN {k}" for k, x in enumerate(order))
    cells = " UNION ALL ".join(f"SELECT {key} AS id, '{x}' AS col, {value} AS text FROM {source}" for x, value in columns.items())
    word = "[\\p{L}\\p{N}]"
    rest = blanket("w") if blanket_rule else "w"
    return rf"""{name}_terms AS MATERIALIZED (SELECT * FROM (SELECT gram, len({words('real')}) AS n, rank, fake, row_number() OVER (PARTITION BY gram ORDER BY rank, category, fake) AS k
 FROM (SELECT *, {gram('real')} AS gram, CASE category {ranks} END AS rank FROM {terms}) WHERE gram <> '' AND rank IS NOT NULL) WHERE k = 1),
 {name}_cells AS MATERIALIZED (SELECT id, col, text, {words('text')} AS low, regexp_extract_all(text, '[^\p{{L}}\p{{N}}]*{word}+') AS pieces FROM ({cells})),
 {name}_at AS MATERIALIZED (SELECT id, col, p AS "at", low, len(low) AS total FROM (SELECT id, col, low, unnest(range(1, len(low) + 1)) AS p FROM {name}_cells)),
 {name}_best AS MATERIALIZED (SELECT id, col, "at", n, fake FROM (SELECT a.id, a.col, a."at", t.n, t.fake, row_number() OVER (PARTITION BY a.id, a.col, a."at" ORDER BY t.rank, t.n DESC) AS k
 FROM (SELECT id, col, "at", unnest(list_transform(range("at", least("at" + 4, total + 1)), lambda x: array_to_string(low["at":x], ' '))) AS gram FROM {name}_at) a JOIN {name}_terms t USING (gram)) WHERE k = 1),
 {name}_walk AS (WITH RECURSIVE w AS (SELECT id, col, CAST(1 AS BIGINT) AS "at", len(low) AS total FROM {name}_cells WHERE len(low) > 0
 UNION ALL SELECT w.id, w.col, w."at" + coalesce(b.n, 1), w.total FROM w LEFT JOIN {name}_best b ON w.id = b.id AND w.col = b.col AND w."at" = b."at" WHERE w."at" + coalesce(b.n, 1) <= w.total) SELECT * FROM w),
 {name}_out AS (SELECT c.id, c.col, w."at", b.fake IS NOT NULL AS hit, regexp_extract(c.pieces[w."at"], '^[^\p{{L}}\p{{N}}]*') AS sep, regexp_extract(c.pieces[w."at"], '{word}+$') AS w, b.fake AS fake
 FROM {name}_walk w JOIN {name}_cells c ON c.id = w.id AND c.col = w.col LEFT JOIN {name}_best b ON w.id = b.id AND w.col = b.col AND w."at" = b."at"),
 {name}_done AS (SELECT id, col, string_agg(sep || CASE WHEN hit THEN fake ELSE {rest} END, '' ORDER BY "at") AS body, count(*) FILTER (hit) AS n_hits FROM {name}_out GROUP BY id, col),
 {name} AS (SELECT c.id, c.col, coalesce(d.body, '') || regexp_extract(c.text, '[^\p{{L}}\p{{N}}]*$') AS text, coalesce(d.n_hits, 0) AS n_hits FROM {name}_cells c LEFT JOIN {name}_done d ON c.id = d.id AND c.col = d.col)"""
