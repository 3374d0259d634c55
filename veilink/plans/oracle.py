"""SQL counterparts of the registered queries, for DuckDB on the same tables.

The texts are assembled from common table expressions, so that one definition of people, damage, tokens,
filters, tree and candidates serves all queries.  Rules and constants are spelled out here rather than imported, so that
a wrong one in the package shows.  There is no sha512 in that dialect: its residues come as a table of all bigrams over the
fixture's alphabet, and a bigram that is not in it gives a null position.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace
from itertools import accumulate

# Fixed values, as the damage rules and the published sweep have them.
CLK, RLB = "CLK", "RLB"
SPELLING_RULES = (
    ("SS", "Ç"), ("Ç", "SS"), ("Z", "S"), ("K", "C"), ("TH", "T"), ("EI", "E"), ("ANA", "ANNA"), ("DE ", ""), ("RR", "R"),
    ("Y", "I"), ("W", "U"),
)
ERROR_LABELS = ("Sem erro", "tipo 1", "tipo 2", "tipo 3", "tipo 4", "tipo 5")
CODE_NOISE, DATE_NOISE = 10_000, 365
STEPS = 100
GRID_ROUNDS, GRID_HASH = 2, "TripleHash"
ALPHABET = "_ .,/-#'0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZÇabcdefghijklmnopqrstuvwxyz"
SUPPRESS, WORDS = (0.25,) * 4, (0.15,) * 6
SEED, BASE_SEED, GUARDIAN_SEED, FRACTION = 1991, 1991, 312, 0.05
SLICE = (100, 400)
GOLD_COLUMNS = ["nome", "data_nasc", "sexo", "mae", "municipio"]


@dataclass(frozen=True)
class Run:
    """Parameters of a linkage run; ``percent`` is the share of each error type."""

    number: int = 1
    m: int = 100
    k: int = 2
    hash: str = "DoubleHash"
    encoding: str = CLK
    percent: int = 5
    attributes: int = 4
    seed: int = SEED

    @property
    def size(self) -> int:
        return self.m * self.attributes

    @property
    def modulus(self) -> int:
        return self.size if self.encoding == CLK else self.m

    @property
    def rlb_slots(self) -> int:
        return self.m * 2 // 5 if self.encoding == RLB else 0


MAIN = Run()
ABF_RUN, RLB_RUN = Run(encoding="ABF"), Run(encoding=RLB)
GOLD = Run(m=200, k=20, encoding="ABF", attributes=5)
TRIPLE_RUN = Run(hash="TripleHash")
SWEEP = [Run(1, encoding="ABF"), Run(2, percent=2), Run(3, encoding=RLB, percent=10)]
GRID = [
    Run((i * 3 + j) * 3 + l + 1, m, GRID_ROUNDS, GRID_HASH, encoding, percent)
    for i, m in enumerate((100, 200, 400))
    for j, encoding in enumerate(("ABF", CLK, RLB))
    for l, percent in enumerate((2, 5, 10))
]


def cut_points(weights) -> list[float]:
    """Upper ends of all parts but the last, for shares of 1."""
    total = sum(weights)
    return [x / total for x in accumulate(weights)][:-1]


def group_shares(percent: float) -> tuple[float, ...]:
    return (1 - 5 * percent / 100,) + (percent / 100,) * 5

PEOPLE = """
dob as (select o_custkey, min(o_orderdate) as d from orders group by o_custkey),
np as (select count(*) as n from part), ns as (select count(*) as n from supplier),
people as (
  select c.c_custkey as id,
    concat(upper(p1.p_name), ' ', c.c_mktsegment, ' ',
           translate(right(c.c_name, 5), '0123456789', 'AEIOSZKYWR')) as name,
    concat(upper(p2.p_name), ' DE ',
           translate(right(s.s_name, 4), '0123456789', 'AEIOSZKYWR')) as guardian,
    strftime(dob.d, '%d/%m/%Y') as birth_date,
    cast(100000 + c.c_nationkey * 1000 + c.c_custkey % 1000 as varchar) as city_code,
    n.n_name as state
  from customer c cross join np cross join ns
  join part p1 on p1.p_partkey = c.c_custkey % np.n
  join part p2 on p2.p_partkey = (c.c_custkey * 7 + 3) % np.n
  join supplier s on s.s_suppkey = c.c_custkey % ns.n
  join nation n on n.n_nationkey = c.c_nationkey
  left join dob on dob.o_custkey = c.c_custkey)"""


def number(x: float) -> str:
    return f"{x!r}e0"


def draw(purpose: str, *keys: str, seed: int = SEED) -> str:
    text = ", ':', ".join([f"'{seed}:{purpose}'", *keys])
    return f"(cast('0x' || substr(md5(concat({text})), 1, 8) as ubigint) / 4294967296e0)"


def bucket(u: str, weights) -> str:
    whens = " ".join(f"when {u} < {number(x)} then {i}" for i, x in enumerate(cut_points(weights)))
    return f"(case {whens} else {len(weights) - 1} end)"


def noise(purpose: str, high: int, key: str = "id") -> str:
    return f"cast(floor({draw(purpose, key)} * {number(float(high + 1))}) as bigint)"


def drop_word(z: str) -> str:
    return f"regexp_replace({z}, '^([^ ]*) [^ ]*', '\\1')"


def abbrev_first(z: str) -> str:
    tail = f"case when starts_with({z}, ' ') then substr({z}, 2) else '' end"
    return f"(case when {z} = '' then {z} else upper(substr({z}, 1, 1)) || '. ' || {tail} end)"


def abbrev_second(z: str) -> str:
    shape = "'^([^ ]*) (.)([^ ]*)(.*)$'"
    part = lambda i: f"regexp_extract({z}, {shape}, {i})"
    return (
        f"(case when regexp_matches({z}, {shape}) then {part(1)} || ' ' || upper({part(2)}) || '.' || {part(4)} "
        f"else {z} end)"
    )


def spelling(z: str) -> str:
    whens = " ".join(f"when contains({z}, '{a}') then replace({z}, '{a}', '{b}')" for a, b in SPELLING_RULES)
    return f"(case {whens} else {z} end)"


def shift_code(z: str) -> str:
    return f"cast(cast({z} as bigint) + {noise('code', CODE_NOISE)} as varchar)"


def shift_date(z: str) -> str:
    moved = f"strptime({z}, '%d/%m/%Y') + to_days(cast({noise('date', DATE_NOISE)} as integer))"
    return f"strftime({moved}, '%d/%m/%Y')"


def damaged(percent: int, name: str = "b", source: str = "people") -> str:
    """B: all people, damaged."""

    def name_like(z: str, i: int) -> str:
        return (
            f"case when g = 1 and s = {i} then '' when g = 2 and w = {i} then {drop_word(z)} "
            f"when g = 2 and w = {2 + i} then {abbrev_first(z)} when g = 2 and w = {4 + i} then {abbrev_second(z)} "
            f"when g = 3 then {spelling(z)} else {z} end as {z}"
        )

    labels = " ".join(f"when {i} then '{x}'" for i, x in enumerate(ERROR_LABELS))
    return f"""
{name}_buckets as (
  select *, {bucket(draw('group', 'id'), group_shares(percent))} as g,
    {bucket(draw('suppress', 'id'), SUPPRESS)} as s, {bucket(draw('words', 'id'), WORDS)} as w
  from {source}),
{name} as (
  select id, {name_like('name', 0)}, {name_like('guardian', 1)},
    case when g = 1 and s = 2 then '' when g = 5 then {shift_date('birth_date')} else birth_date end as birth_date,
    case when g = 1 and s = 3 then '' when g = 4 then {shift_code('city_code')} else city_code end as city_code,
    state, id % 20 <> 19 as has_partner, case g {labels} end as error_type
  from {name}_buckets)"""


SIDE_A = "a as (select * from people where id % 20 <> 19)"
ATTRS = ["name", "guardian", "birth_date", "city_code"]


def tokens(name: str, source: str, attrs: list[str] = ATTRS) -> str:
    parts = " union all ".join(f"select id, {i} as attr_idx, {x} as v from {source}" for i, x in enumerate(attrs))
    return f"""
{name}_values as ({parts}),
{name}_tokens as (
  select id, attr_idx, substr('_' || v || '_', cast(i as integer), 2) as token
  from (select id, attr_idx, v, unnest(generate_series(1, length(v) + 1)) as i from {name}_values where v is not null))"""


def sha512_table(m: int) -> str:
    """(token, r3): sha512 residues of all bigrams over the fixture's alphabet."""
    pairs = [x + y for x in ALPHABET for y in ALPHABET]
    rows = ", ".join(
        f"('{t.replace(chr(39), chr(39) * 2)}', {int(hashlib.sha512(t.encode()).hexdigest(), 16) % m})" for t in pairs
    )
    return f"(values {rows}) sha(token, r3)"


def residues(source: str, m: int, triple: bool = False) -> str:
    """md5 and sha256 residues of distinct tokens, sha256 in two halves; sha512 from its table."""
    if triple:
        return f"select x.*, r3 from ({residues(source, m)}) x left join {sha512_table(m)} using (token)"
    step = pow(2, 128, m)
    half = lambda start: f"(cast('0x' || substr(sha256(token), {start}, 32) as uhugeint) % {m})"
    return (
        f"select token, cast(cast('0x' || md5(token) as uhugeint) % {m} as bigint) as r1, "
        f"cast(({half(1)} * {step} + {half(33)}) % {m} as bigint) as r2 from (select distinct token from {source})"
    )


def bits(name: str, config: Run) -> str:
    """(id, bit) of a table's tokens."""
    offset = "0" if config.encoding == CLK else f"attr_idx * {config.m}"
    m = config.modulus
    raw = f"{name}_source" if config.encoding == RLB else f"{name}_bits"
    text = f"""
{name}_hash as ({residues(f'{name}_tokens', m, config.hash == "TripleHash")}),
{name}_book as (select token, (r1 + i * r2{" + i * (i - 1) // 2 * r3" if config.hash == "TripleHash" else ""}) % {m} as pos from {name}_hash, range(1, {config.k + 1}) t(i)),
{raw} as (select distinct id, cast(pos + {offset} as integer) as bit from {name}_tokens join {name}_book using (token))"""
    if config.encoding == RLB:
        text += f"""{gather(name, config)},
{name}_bits as (select distinct id, dst as bit from {raw} join {name}_gather on src = bit)"""
    return text


def gather(name: str, config: Run) -> str:
    m = config.m
    slot, pick, mix = (
        draw("rlb-slot", "attr_idx", "pos", seed=config.seed),
        draw("rlb-pick", "attr_idx", "pos", seed=config.seed),
        draw("rlb-shuffle", "slot", seed=config.seed),
    )
    return f""",
{name}_slots as (
  select slot, slot // {m} as attr_idx, slot % {m} as pos from (select cast(i as bigint) as slot from range(0, {config.size}) t(i))),
{name}_picks as (
  select attr_idx, pos as picked, row_number() over (partition by attr_idx order by {pick}, pos) - 1 as rank
  from {name}_slots where pos < {m - 1}),
{name}_drawn as (
  select attr_idx, cast(floor({slot} * {config.rlb_slots}) as bigint) as rank,
    row_number() over (order by {mix}, slot) - 1 as dst from {name}_slots),
{name}_gather as (
  select cast(picked + attr_idx * {m} as integer) as src, cast(dst as integer) as dst
  from {name}_drawn join (select * from {name}_picks where rank < {config.rlb_slots}) using (attr_idx, rank))"""


def tree(name: str, a_bits: str, b_bits: str | None) -> str:
    """Recursive descent of A's and B's records together; counts are taken on A only."""
    sides = f"select 0 as side, id, bit from {a_bits}"
    if b_bits:
        sides += f" union all select 1, id, bit from {b_bits}"
    return f"""
{name}_rows as ({sides}),
{name}(lvl, side, id, path, fin) as (
  select 0, side, id, '', false from (select distinct side, id from {name}_rows)
  union all
  select * from (
    with cur as (select * from {name} where not fin),
      act as (select path, n from (select path, count(*) n, max(lvl) lvl from cur where side = 0 group by path)
              where lvl = 0 or n > 5),
      cnt as (select c.path, r.bit, count(*) k from cur c join {name}_rows r on r.side = c.side and r.id = c.id
              where c.side = 0 group by 1, 2),
      best as (select path, arg_min(bit, abs(k - n / 2.0) * 100000 + bit) bit from cnt join act using (path)
               where k < n group by path),
      hit as (select c.side, c.id from cur c join best using (path)
              join {name}_rows r on r.side = c.side and r.id = c.id and r.bit = best.bit)
    select c.lvl + 1, c.side, c.id,
      case when best.bit is null then c.path when hit.id is not null then c.path || '1' else c.path || '0' end,
      best.bit is null
    from cur c left join best using (path) left join hit on hit.side = c.side and hit.id = c.id)),
{name}_leaf as (select side, id, path from {name} where fin)"""


def same_filters(name: str, a_bits: str) -> str:
    """First id and copy count of A's distinct filters."""
    return f"""
{name}_sig as (select id, string_agg(bit, ',' order by bit) as sig, count(*) as ones from {a_bits} group by id),
{name}_reps as (select sig, min(id) as id_a, count(*) as copies from {name}_sig group by sig),
{name}_first as (select id, id_a, copies, ones from {name}_sig join {name}_reps using (sig))"""


def scored(name: str, a_bits: str, b_bits: str, pairs: str) -> str:
    """Dice of the pairs (id, id_a) listed by ``pairs``."""
    return f"""
{name}_b_ones as (select id, count(*) as ones from {b_bits} group by id),
{name}_both as (
  select p.id, p.id_a, count(*) as both from ({pairs}) p join {b_bits} x on x.id = p.id
  join {a_bits} y on y.id = p.id_a and y.bit = x.bit group by 1, 2),
{name}_cand as (
  select p.id, p.id_a, f.copies, 2.0e0 * coalesce(q.both, 0) / (f.ones + o.ones) as dice
  from ({pairs}) p left join {name}_both q on q.id = p.id and q.id_a = p.id_a
  join {name}_first f on f.id = p.id_a join {name}_b_ones o on o.id = p.id),
{name}_best as (
  select id, max(struct_pack(d := dice, r := -id_a)) as top from {name}_cand where dice > 0 group by id)"""


def linked(name: str, a_bits: str, b_bits: str, b: str, truth: str = "id", first_only: bool = True) -> str:
    """Best link of every B row; ``first_only`` lists one candidate per distinct filter, else all records of the leaf."""
    first = f"join {name}_first f on f.id = x.id and f.id_a = x.id " if first_only else ""
    pairs = (
        f"select y.id as id, x.id as id_a from {name}_t_leaf x join {name}_t_leaf y on x.path = y.path "
        f"{first}where x.side = 0 and y.side = 1"
    )
    return f"""{tree(name + '_t', a_bits, b_bits)},{same_filters(name, a_bits)},{scored(name, a_bits, b_bits, pairs)},
{name}_links as (
  select b.*, b.{truth} as truth, -top.r as best_a, top.d as dice,
    cast(coalesce(-top.r = b.{truth}, false) as integer) as hit
  from {b} b left join {name}_best using (id))"""


def query(select: str, *ctes: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{','.join(x.strip() for x in ctes)}\n{select}"


def synthetic_run(config: Run) -> list[str]:
    return [
        PEOPLE, SIDE_A, damaged(config.percent), tokens("a", "a"), bits("a", config), tokens("b", "b"),
        bits("b", config), linked("l", "a_bits", "b_bits", "b"),
    ]


CURVE = """
labelled as (select coalesce(cast(cast(dice as float) as double), 0) as score, hit from l_links),
scores as (
  select score, sum(pos) as pos, sum(neg) as neg from (
    select score, cast(sum(hit) as bigint) as pos, cast(sum(1 - hit) as bigint) as neg from labelled group by score
    union all select 0, 0, 1 from labelled having min(hit) = 1) group by score),
points as (
  select score as threshold, sum(pos) over up / sum(pos) over () as tpr, sum(neg) over up / sum(neg) over () as fpr
  from scores window up as (order by score desc rows unbounded preceding)
  union all select cast('inf' as double), 0, 0),
area as (
  select sum((fpr - fpr0) * (tpr + tpr0) / 2) as roc_area from (
    select fpr, tpr, lag(fpr) over o as fpr0, lag(tpr) over o as tpr0 from points window o as (order by threshold desc))),
youden as (select max(struct_pack(j := tpr - fpr, t := threshold)).t as threshold from points)"""

VERDICTS = """
pairs as (
  select b.*, c.copies, cast(cast(c.dice as float) as double) as score,
    coalesce(f.id_a = c.id_a, false) as is_true
  from l_links b join l_cand c on c.id = b.id left join l_first f on f.id = b.truth),
verdicts as (
  select id, ANY_TYPE,
    cast(sum(case when is_true and score >= threshold then 1 else 0 end) as bigint) as VP,
    cast(sum(case when score >= threshold then copies else 0 end)
         - sum(case when is_true and score >= threshold then 1 else 0 end) as bigint) as FP,
    cast(sum(case when score >= threshold then 0 else copies end)
         - sum(case when is_true and score < threshold then 1 else 0 end) as bigint) as VN,
    cast(sum(case when is_true and score < threshold then 1 else 0 end) as bigint) as FN
  from pairs cross join youden group by id)"""


def verdicts(label: str | None) -> str:
    return VERDICTS.replace("ANY_TYPE", f"any_value({label}) as {label}" if label else "0 as none")


def ratios(config: Run) -> str:
    f = lambda x: f"round(cast(cast({x} as float) as double), 6)"
    p, r = "cast(cast(p as float) as double)", "cast(cast(r as float) as double)"
    return f"""
    VP, FP, VN, FN, {config.m} as "tamanho_BF", {config.k} as quant_hash, '{config.hash}' as tipo_hash,
    '{config.encoding}' as "tipo_BF", {number(config.rlb_slots / config.m)} as porcentagem_rlb,
    round(threshold, 6) as threshold, round(roc_area, 6) as roc_area,
    {f('r')} as pair_completeness,
    {f('1 - all_pairs / (cast(size_a as double) * registros)')} as "reduction rate",
    {f('VP / all_pairs')} as "pair quality", {f('(VP + VN) / all_pairs')} as acuracia, {f('p')} as precisao,
    {f(f'case when {p} + {r} = 0 then null else 2 * {p} * {r} / ({p} + {r}) end')} as "f-score\""""


SUMS = """
sums as (
  select *, case when VP = 0 then 0 else VP / (VP + FP) end as p, VP / registros as r,
    cast(VP + FP + VN + FN as double) as all_pairs
  from (select KEY cast(sum(VP) as bigint) as VP, cast(sum(FP) as bigint) as FP, cast(sum(VN) as bigint) as VN,
          count(*) - cast(sum(VP) as bigint) as FN, count(*) as registros from verdicts GROUPING)
  cross join youden cross join area cross join (select count(*) as size_a from a))"""


def sums(key: str | None) -> str:
    return SUMS.replace("KEY", f"{key}," if key else "").replace("GROUPING", f"group by {key}" if key else "")


def grid_rows() -> str:
    return """
grid as (
  select cast((i * 3 + j) * 3 + l + 1 as integer) as config_id, cast(m as integer) as m, encoding, percent,
    percent / 20e0 as error_share
  from (values (0, 100), (1, 200), (2, 400)) a(i, m), (values (0, 'ABF'), (1, 'CLK'), (2, 'RLB')) b(j, encoding),
    (values (0, 2), (1, 5), (2, 10)) d(l, percent))"""


def share_groups() -> str:
    parts = " union all ".join(
        f"select {x} as percent, {bucket(draw('group', 'id'), group_shares(x))} as error_group from people"
        for x in (2, 5, 10)
    )
    return f"drawn as ({parts})"


def sample(seed: int, columns: str) -> str:
    return f"select {columns} from people where state is not null and {draw('stratum', 'id', seed=seed)} < {number(FRACTION)}"


def inverse(key: str, seed: int) -> str:
    """Date text from the quantile grid ``q(i, v)`` at the draw of ``key``."""
    u = f"({draw('synthetic-date', key, seed=seed)} * {number(float(STEPS))})"
    value = f"lo.v + (hi.v - lo.v) * ({u} - floor({u}))"
    return f"strftime(date '1970-01-01' + cast(round({value}) as integer), '%d/%m/%Y')"


QUANTILES = f"""
days as (select cast(date_diff('day', date '1970-01-01', cast(o_orderdate as date)) as bigint) as day from orders
         where o_orderdate is not null),
q as (select i, round(v, 6) as v from (
  select unnest(range(0, {STEPS + 1})) as i,
    unnest(quantile_cont(day, [{', '.join(number(i / STEPS) for i in range(STEPS + 1))}])) as v from days))"""


def at_draw(source: str, key: str, seed: int) -> str:
    low = f"cast(floor({draw('synthetic-date', key, seed=seed)} * {number(float(STEPS))}) as bigint)"
    return f"{source} r join q lo on lo.i = {low} join q hi on hi.i = {low} + 1"


CITIES = """cities as (
  select case when n_nationkey < 20 then n_name else 'NOVA ' || n_name end as city, 1000 + n_nationkey as code from nation)"""


def damage_queries() -> dict[str, str]:
    rules = {
        "corrupt_suppress": "'' as name, '' as guardian",
        "corrupt_drop_word": f"{drop_word('name')} as name, {drop_word('guardian')} as guardian",
        "corrupt_abbrev_first": f"{abbrev_first('name')} as name, {abbrev_first('guardian')} as guardian",
        "corrupt_abbrev_second": f"{abbrev_second('name')} as name, {abbrev_second('guardian')} as guardian",
        "corrupt_spelling": f"{spelling('name')} as name, {spelling('guardian')} as guardian",
        "corrupt_code": f"{shift_code('city_code')} as city_code",
        "corrupt_date": f"{shift_date('birth_date')} as birth_date",
    }
    return {name: query(f"select id, {columns} from people", PEOPLE) for name, columns in rules.items()}


def hash_query(k: int, family: str = "") -> str:
    term = {
        "": "0", "enhanced": "cast(trunc(xor(i, 3 - i) / 6.0e0) as bigint)", "triple": "i * (i - 1) // 2 * r3",
    }[family]
    pos = f"cast((((r1 + i * r2 + {term}) % 100) + 100) % 100 as bigint)"
    return query(
        f"select token, cast(i as integer) as round, {pos} as pos, uses from h join u using (token), range(1, {k + 1}) t(i)",
        PEOPLE, tokens("p", "people"), f"h as ({residues('p_tokens', 100, family == 'triple')})",
        "u as (select token, count(*) as uses from p_tokens group by token)",
    )


def encode_query(config: Run) -> str:
    return query("select id, bit from p_bits", PEOPLE, tokens("p", "people"), bits("p", config))


def first_splits(levels: int) -> str:
    parts = [PEOPLE, SIDE_A, tokens("a", "a"), bits("a", MAIN), "n0 as (select id, '' as path from a)"]
    selects = []
    for i in range(levels):
        parts.append(f"""
s{i} as (
  select path, n, max(struct_pack(g := -abs(2 * k - n), b := -bit, k := k)) as best from (
    select path, bit, count(*) as k from n{i} join a_bits using (id) group by path, bit)
  join (select path, count(*) as n from n{i} group by path having count(*) > {5 if i else 0}) using (path)
  where k < n group by path, n),
n{i + 1} as (
  select x.id, x.path || case when y.id is null then '0' else '1' end as path
  from n{i} x join s{i} s using (path) left join a_bits y on y.id = x.id and y.bit = -s.best.b)""")
        selects.append(
            f"select path as node_path, cast(-best.b as integer) as bit, n as records, best.k as with_bit from s{i}"
        )
    return query(" union all ".join(selects), *parts)


def sweep_query() -> str:
    parts = [PEOPLE, SIDE_A, tokens("a", "a")]
    selects = []
    for config in SWEEP:
        n = config.number
        parts += [
            damaged(config.percent, f"b{n}"), tokens(f"b{n}", f"b{n}"), bits(f"b{n}", config),
            f"a{n}_tokens as (select * from a_tokens)", bits(f"a{n}", config),
            linked(f"l{n}", f"a{n}_bits", f"b{n}_bits", f"b{n}"),
        ]
        selects.append(f"select {n} as config_id, id, error_type, best_a, round(dice, 6) as dice, hit from l{n}_links")
    return query(" union all ".join(selects), *parts, recursive=True)


def gold_query() -> str:
    columns = (
        "name as nome, birth_date as data_nasc, case when id % 2 = 0 then 'F' else 'M' end as sexo, "
        "guardian as mae, city_code as municipio"
    )
    shaped = f"gold as (select id, {columns} from people)"
    b = f'b as (select id + 1000000 as id, id as "check", {columns} from d)'
    return query(
        f"select {ratios(GOLD)} from sums", PEOPLE, damaged(5, "d"), shaped, "a as (select * from gold where id % 20 <> 19)", b,
        tokens("a", "a", GOLD_COLUMNS), bits("a", GOLD), tokens("b", "b", GOLD_COLUMNS), bits("b", GOLD),
        linked("l", "a_bits", "b_bits", "b", '"check"'), CURVE, verdicts(None), sums(None), recursive=True,
    )


COPIES_A = """
a as (select * from people where id % 20 <> 19 union all
  select id + 1000000 as id, * exclude (id) from people where id % 20 = 7)"""

REPEATED_A = """
a as (
  select id, case when id % 20 = 3 then guardian else name end as name, case when id % 20 = 3 then name else guardian end as guardian,
    birth_date, city_code from people where id % 20 <> 19)"""
REPEATED_B = """
b as (
  select id, id as "check", name, guardian, birth_date, city_code from d union all
  select id + 10000000, id, guardian, name, birth_date, city_code from d where id % 20 = 5)"""


def on_sides(a: str, config: Run, b: list[str], truth: str = "id", first_only: bool = True) -> list[str]:
    return [
        PEOPLE, a, *b, tokens("a", "a"), bits("a", config), tokens("b", "b"), bits("b", config),
        linked("l", "a_bits", "b_bits", "b", truth, first_only),
    ]


def grid_query() -> str:
    """All configurations of the sweep, in steps that each hold little.

    The three error shares are three ranges of B ids, the nine encodings (size and kind) nine ranges of ids on both sides,
    each with a letter as the root of its tree.  The trees grow level by level on A's records alone and leave their
    splits; B's records then walk the splits with their bits as a list, and are compared within their leaf by lists.
    """
    by_share, by_encoding = {2: 10_000_000, 5: 20_000_000, 10: 30_000_000}, 1_000_000_000
    letter = f"chr(65 + cast(id // {by_encoding} as integer))"
    parts = [PEOPLE, SIDE_A, tokens("a", "a"), *[damaged(p, f"b{p}") for p in by_share]]
    sides = " union all ".join(
        f"select id + {by} as id, id as true_id, {i} as share, error_type, {', '.join(ATTRS)} from b{p}"
        for i, (p, by) in enumerate(by_share.items())
    )
    parts += [f"b as ({sides})", tokens("b", "b")]
    encodings = [c for c in GRID if c.percent == 2]  # the first of the three that share an encoding
    for e, config in enumerate(encodings):
        for side in "ab":
            parts += [f"{side}{e}_tokens as (select * from {side}_tokens)", bits(f"{side}{e}", config)]
    for side in "ab":
        lists = " union all ".join(
            f"select id + {e * by_encoding} as id, list(bit order by bit) as bits from {side}{e}_bits group by id"
            for e in range(len(encodings))
        )
        parts.append(f"{side}_rows as materialized ({lists})")
    parts.append(f"""
grown(lvl, id, path, bit, fin) as (
  select 0, id, {letter}, cast(null as integer), false from a_rows
  union all
  select * from (
    with cur as (select * from grown where not fin),
      act as (select path, count(*) as n, max(lvl) as lvl from cur group by path having max(lvl) = 0 or count(*) > 5),
      cnt as (select path, bit, count(*) as k from (select c.path, unnest(r.bits) as bit from cur c join a_rows r using (id))
              group by all),
      best as (select path, arg_min(bit, abs(k - n / 2.0) * 100000 + bit) as bit from cnt join act using (path)
               where k < n group by path)
    select c.lvl + 1, c.id, case when best.bit is null then c.path
        when list_contains(r.bits, best.bit) then c.path || '1' else c.path || '0' end, best.bit, best.bit is null
    from cur c join a_rows r using (id) left join best using (path))),
splits as (select distinct left(path, length(path) - 1) as path, bit from grown where bit is not null),
walked(id, path) as (
  select id, {letter} from b_rows
  union all
  select w.id, w.path || case when list_contains(r.bits, s.bit) then '1' else '0' end
  from walked w join splits s using (path) join b_rows r using (id)),
filters as (select left(path, 1) as root, path, bits, min(id) as id_a from grown join a_rows using (id) where fin group by all),
pairs as (
  select w.id, f.id_a, 2.0e0 * len(list_intersect(f.bits, r.bits)) / (len(f.bits) + len(r.bits)) as dice
  from walked w join filters f using (path) join b_rows r on r.id = w.id),
best as (select id, max(struct_pack(d := dice, r := -id_a)) as top from pairs where dice > 0 group by id),
wanted as (select id + e * {by_encoding} as id, true_id, share, error_type, e from b, range(0, {len(encodings)}) t(e))""")
    found = f"(-top.r) % {by_encoding}"
    return query(
        f"select cast(e * 3 + share + 1 as integer) as config_id, true_id as id, error_type, {found} as best_a, "
        f"round(top.d, 6) as dice, cast(coalesce({found} = true_id, false) as integer) as hit from wanted left join best using (id)",
        *parts, recursive=True,
    )


LINE = "l_returnflag, l_orderkey, l_linenumber, l_quantity"


def tied_slices() -> str:
    total = "l_returnflag nulls first, l_orderkey nulls first, l_linenumber nulls first, l_quantity nulls first"
    return (
        f"with n as (select {LINE}, row_number() over (order by {total}) - 1 as i from lineitem) "
        f"select case when i < 50 then 'head' else 'middle' end as slice, {LINE} from n where i < 50 or i between 12000 and 12099"
    )


def all_sql() -> dict[str, str]:
    run = synthetic_run(MAIN)
    curve = [*run, CURVE]
    low, high = SLICE
    everyone = "select y.id as id, x.id as id_a from a x join l_first f on f.id = x.id and f.id_a = x.id cross join b y"
    two_samples = (
        f"s1 as ({sample(BASE_SEED, 'id, name, state, city_code')})",
        f"s2 as ({sample(GUARDIAN_SEED, 'id, name, state, city_code')})",
    )
    zipped = """
z as (select x.ordinal, x.id, x.name, x.state, y.id as id_2, y.name as guardian
      from (select *, row_number() over (order by id) - 1 as ordinal from s1) x
      join (select *, row_number() over (order by id) - 1 as ordinal from s2) y using (ordinal))"""
    return {
        "people_base": query(
            "select *, cast(city_code as integer) as code from people where birth_date is not null", PEOPLE
        ),
        "register_join": query(
            'select p.id, p.state as "UF", p.name as "NOME", p.state as "MUNICIPIO", cast(x.code as integer) as code '
            "from people p left join cities x on x.city = p.state", PEOPLE, CITIES,
        ),
        "csv_roundtrip": query("select * from people", PEOPLE),
        "slice_rows": query(
            f"select id, name, guardian from people order by id limit {high - low} offset {low}", PEOPLE
        ),
        "config_grid": query(
            "select config_id, m, m * 4 as size, encoding, error_share, error_group, count(*) as records "
            "from grid join drawn using (percent) group by all", PEOPLE, grid_rows(), share_groups(),
        ),
        "config_parse": query(
            f"select config_id, m, m * 4 as size, {GRID_ROUNDS} as k, '{GRID_HASH}' as hash, encoding, "
            "case when encoding = 'RLB' then floor(m * 0.4e0) / m else 0e0 end as rlb_share, error_share, "
            "count(*) as damaged from grid join drawn using (percent) where error_group > 0 group by all",
            PEOPLE, grid_rows(), share_groups(),
        ),
        "stratified_sample": query(
            f"select 1 as sample, * from ({sample(BASE_SEED, 'id, state, name')}) union all "
            f"select 2, * from ({sample(GUARDIAN_SEED, 'id, state, name')})", PEOPLE,
        ),
        "error_buckets": query(
            f"select {bucket(draw('group', 'id'), group_shares(5))} as error_group, "
            f"{bucket(draw('suppress', 'id'), SUPPRESS)} as suppress_choice, "
            f"{bucket(draw('words', 'id'), WORDS)} as word_choice, count(*) as records from people group by all",
            PEOPLE,
        ),
        **damage_queries(),
        "corrupt_all": query("select * from b", PEOPLE, damaged(5)),
        "error_types": query("select distinct error_type from b order by 1", PEOPLE, damaged(5)),
        "bigrams": query(
            "select id, attr_idx, token, count(*) as times from p_tokens group by all", PEOPLE, tokens("p", "people")
        ),
        "hash_double": hash_query(3),
        "hash_enhanced": hash_query(20, "enhanced"),
        "hash_triple": hash_query(3, "triple"),
        "encode_abf": encode_query(ABF_RUN),
        "encode_clk": encode_query(MAIN),
        "encode_rlb": encode_query(RLB_RUN),
        "encode_block30": query(
            "select id, cast(bit_or(cast(1 as bigint) << pos) as bigint) as block from p_tokens join book using (token) "
            "group by id",
            PEOPLE, tokens("p", "people", ["name"]), f"h as ({residues('p_tokens', 30)})",
            "book as (select token, (r1 + i * r2) % 30 as pos from h, range(1, 4) t(i))",
        ),
        "dense_filter": query(
            "select p.id, string_agg(case when b.bit is null then '0' else '1' end, '' order by t.i) as filter "
            f"from people p cross join range(0, {MAIN.size}) t(i) left join p_bits b on b.id = p.id and b.bit = t.i "
            "group by p.id", PEOPLE, tokens("p", "people"), bits("p", MAIN),
        ),
        "tree_first_split": first_splits(1),
        "tree_two_levels": first_splits(2),
        "tree_leaves": query(
            "select id, path as node_path from t_leaf", PEOPLE, SIDE_A, tokens("a", "a"), bits("a", MAIN),
            tree("t", "a_bits", None), recursive=True,
        ),
        "tree_splits": query(
            "select path as node_path, arg_min(bit, abs(k - n / 2.0) * 100000 + bit) as bit from ("
            "select path, bit, count(*) as k from inner_rows join a_bits using (id) group by path, bit) "
            "join (select path, count(*) as n from inner_rows group by path) using (path) where k < n group by path",
            PEOPLE, SIDE_A, tokens("a", "a"), bits("a", MAIN), tree("t", "a_bits", None),
            "inner_rows as (select id, substr(path, 1, i) as path "
            "from (select id, path, unnest(range(0, length(path))) as i from t_leaf))", recursive=True,
        ),
        "link_exhaustive": query(
            "select b.id, error_type, -top.r as best_a, round(top.d, 6) as dice, "
            "cast(coalesce(-top.r = b.id, false) as integer) as hit from b left join l_best using (id)",
            PEOPLE, SIDE_A, damaged(5), tokens("a", "a"), bits("a", MAIN), tokens("b", "b"), bits("b", MAIN),
            same_filters("l", "a_bits"), scored("l", "a_bits", "b_bits", everyone),
        ),
        "link_tree": query(
            "select id, error_type, best_a, round(dice, 6) as dice, hit from l_links", *run, recursive=True
        ),
        "candidate_map": query(
            "select id, id_a, round(cast(cast(dice as float) as double), 6) as dice, copies from l_cand", *run,
            recursive=True,
        ),
        "roc_points": query(
            "select round(threshold, 6) as threshold, round(tpr, 6) as tpr, round(fpr, 6) as fpr from points", *curve,
            recursive=True,
        ),
        "roc_auc": query("select round(roc_area, 6) as roc_area from area", *curve, recursive=True),
        "youden_threshold": query("select round(threshold, 6) as threshold from youden", *curve, recursive=True),
        "hit_rate": query("select round(avg(hit), 6) as hit_rate from l_links", *run, recursive=True),
        "pair_verdicts": query("select id, VP, FP, VN, FN from verdicts", *curve, verdicts(None), recursive=True),
        "report_by_error": query(
            f"select {ratios(MAIN)}, {number(0.25)} as porcentagem_erro, error_type as \"Tipo_erro\", "
            'cast(sum(registros) over () as bigint) as "tam_baseB" from sums',
            *curve, verdicts("error_type"), sums("error_type"), recursive=True,
        ),
        "report_gold": gold_query(),
        "sweep_links": sweep_query(),
        "sweep_from_file": grid_query(),
        "link_tree_triple": query(
            "select id, error_type, best_a, round(dice, 6) as dice, hit from l_links", *synthetic_run(TRIPLE_RUN), recursive=True
        ),
        "report_by_error_triple": query(
            f"select {ratios(TRIPLE_RUN)}, {number(0.25)} as porcentagem_erro, error_type as \"Tipo_erro\", "
            'cast(sum(registros) over () as bigint) as "tam_baseB" from sums',
            *synthetic_run(TRIPLE_RUN), CURVE, verdicts("error_type"), sums("error_type"), recursive=True,
        ),
        "link_repeated_ids": query(
            'select "check" as id, best_a, round(dice, 6) as dice, hit from l_links',
            *on_sides(REPEATED_A, MAIN, [damaged(5, "d"), REPEATED_B], '"check"'), recursive=True,
        ),
        "candidate_pairs": query(
            "select id, id_a, round(dice, 6) as dice from l_cand",
            *on_sides(COPIES_A, MAIN, [damaged(5)], "id", False), recursive=True,
        ),
        "candidate_map_copies": query(
            "select c.id, -top.r as best_a, count(*) over (partition by c.id) as entries, c.id_a, "
            "round(cast(cast(c.dice as float) as double), 6) as dice from l_cand c left join l_best using (id)",
            *on_sides(COPIES_A, MAIN, [damaged(5)], "id", False), recursive=True,
        ),
        "pair_verdicts_copies": query(
            "select id, VP, FP, VN, FN from verdicts", *on_sides(COPIES_A, MAIN, [damaged(5)]), CURVE, verdicts(None), recursive=True
        ),
        "report_by_error_copies": query(
            f"select {ratios(MAIN)}, {number(0.25)} as porcentagem_erro, error_type as \"Tipo_erro\", "
            'cast(sum(registros) over () as bigint) as "tam_baseB" from sums',
            *on_sides(COPIES_A, MAIN, [damaged(5)]), CURVE, verdicts("error_type"), sums("error_type"), recursive=True,
        ),
        "slice_ties": tied_slices(),
        "folder_scan": query("select id, name, state as table_name from people", PEOPLE),
        "append_results": query(
            "select error_type as \"Tipo_erro\", id, state from b union all select error_type, id, state from b", PEOPLE, damaged(5)
        ),
        "append_runs": query(
            "select 'first/1' as run, error_type as \"Tipo_erro\", id, state from b where id % 3 = 0 "
            "union all select 'second', error_type, id, state from b where id % 2 = 0", PEOPLE, damaged(5),
        ),
        "zip_join": query("select ordinal, id, name, id_2, guardian from z", PEOPLE, *two_samples, zipped),
        "synthetic_dates": query(
            f"select r.id, {inverse('r.id', SEED)} as data_nasc from {at_draw('people', 'r.id', SEED)}",
            PEOPLE, QUANTILES,
        ),
        "synthetic_base": query(
            f'select r.ordinal as "ID", cast(x.code as integer) as "COD_MUNICIPIO", r.name as "NOME", '
            f'r.guardian as "NOME_RESPONSAVEL", {inverse("r.ordinal", BASE_SEED)} as data_nasc '
            f"from {at_draw('z', 'r.ordinal', BASE_SEED)} join cities x on x.city = r.state",
            PEOPLE, QUANTILES, CITIES, *two_samples, zipped,
        ),
    }
