"""The step-down likelihood-ratio test as SQL, for sites whose reads show A, C, G and T only."""

from __future__ import annotations

_MASS = " + ".join(f"x.{b} * f{b}" for b in "acgt")
_NEXT = ", ".join(f"list_sum(list_transform(rs, lambda x: x.n * x.{b} * f{b} / ({_MASS}))) / total f{b}" for b in "acgt")
_F = "fa, fc, fg, ft"


def _fit(name: str, keys: str, start: str) -> str:
    """EM with the stop rule from every row of ``start`` (keys, sub, total, rs and frequencies)."""
    return f"""
em_{name} as (select {keys}, sub, total, rs, {_F}, cast(null as double[]) logs, 0 k, false done from {start}
  union all select {keys}, sub, total, rs, {_NEXT}, nl, k + 1, coalesce(list_sum(list_transform(list_zip(nl, logs, rs), lambda z: abs(z[1] - z[2]) * z[3].n)) < cast(0.001 as float), false)
  from (select *, list_transform(rs, lambda x: ln({_MASS})) nl from em_{name} where not done and k < 101)),
fit_{name} as (select {keys}, sub, {_F}, list_sum(list_transform(list_zip(logs, rs), lambda z: z[1] * z[2].n)) ll from em_{name} where done or k = 101)"""


def _step(i: int, keys: str) -> str:
    """One allele less at each site whose best smaller model isn't rejected."""
    kept = ", ".join(f"case when contains(sub, '{b}') then f{b.lower()} else 0 end f{b.lower()}" for b in "ACGT")
    seen = ", ".join(f"case when contains(sub, '{b}') then d{b.lower()} else 0 end d{b.lower()}" for b in "ACGT")
    start = ", ".join(f"case when fa + fc + fg + ft > 0 then f{b} / (fa + fc + fg + ft) else d{b} / (da + dc + dg + dt) end f{b}" for b in "acgt")
    moved = ", ".join(f"case when p.sub is not null and p.chi < 24 then p.f{b} else s.f{b} end f{b}" for b in "acgt")
    return f""",
cut_{i} as (select {keys}, total, rs, replace(keep, l, '') sub, {_F}, da, dc, dg, dt from (select *, unnest(string_split(keep, '')) l from state_{i - 1} where not stop and length(keep) > 1)),
held_{i} as (select {keys}, total, rs, sub, {kept}, {seen} from cut_{i}),
start_{i} as (select {keys}, total, rs, sub, {start} from held_{i}),{_fit(str(i), keys, f'start_{i}')},
pick_{i} as (select f.*, 2 * (s.lr - f.ll) chi from fit_{i} f join state_{i - 1} s using ({keys}) qualify row_number() over (partition by {keys} order by round(2 * (s.lr - f.ll), 6), f.sub) = 1),
state_{i} as (select {', '.join('s.' + k.strip() for k in keys.split(','))}, s.ref_base, s.total, s.rs, s.da, s.dc, s.dg, s.dt, s.full_ll, s.ref_ll, s.first_n, coalesce(p.chi, s.chi) chi, coalesce(p.ll, s.lr) lr, s.stop or coalesce(p.chi >= 24, false) stop,
  case when p.sub is not null and p.chi < 24 then p.sub else s.keep end keep, {moved} from state_{i - 1} s left join pick_{i} p using ({keys}))"""


def step_down(keys: str, source: str, min_af: float, among: str = "'ACGT'") -> str:
    """Common table expressions up to ``state_3``: the kept alleles (``keep``), their frequencies, and
    the tests' figures; ``source`` holds keys, ref_base, read_base and bq."""
    lik = ", ".join(f"case when read_base = '{b}' then 1 - e else e / 3 end {b.lower()}" for b in "ACGT")
    depth = ", ".join(f"sum(case when read_base = '{b}' then n else 0 end) d{b.lower()}" for b in "ACGT")
    active = ", ".join(f"case when contains(among, '{b}') and d{b.lower()} > 0 and d{b.lower()} / cast(total as double) >= cast({min_af} as float) then '{b}' else '' end" for b in "ACGT")
    first = ", ".join(f"case when contains(keep, '{b}') then d{b.lower()} / cast(total as double) else 0 end f{b.lower()}" for b in "ACGT")
    return f"""m_alike as (select {keys}, ref_base, {among} among, read_base, bq, count(*) n from {source} group by all),
m_lik as (select *, {lik}, ln(case when read_base = ref_base then 1 - e else e / 3 end) r from (select *, exp(bq * -0.2302585093) e from m_alike)),
m_site as (select {keys}, ref_base, among, cast(sum(n) as bigint) total, list(struct_pack(n := n, a := a, c := c, g := g, t := t) order by read_base, bq) rs, sum(n * r) ref_ll, {depth} from m_lik group by all),
m_active as (select * from (select *, concat({active}) keep from m_site) where keep <> ''),
m_start as (select *, keep sub, {first} from m_active),{_fit('0', keys, 'm_start')},
state_0 as (select {', '.join('a.' + k.strip() for k in keys.split(','))}, a.ref_base, a.total, a.rs, da, dc, dg, dt, f.ll full_ll, a.ref_ll, length(a.keep) first_n, 0.0e0 chi, f.ll lr, false stop, a.keep, f.fa, f.fc, f.fg, f.ft from m_active a join fit_0 f using ({keys})){''.join(_step(i, keys) for i in (1, 2, 3))}"""


#: A rational approximation of the complementary error function's logarithm.
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def log10_tail(x: str, df: str = "1") -> str:
    """log10 of the chi-square tail for 1 to 3 degrees of freedom, to about 1e-7 of the tail."""
    t = f"(1 / (1 + 0.5e0 * sqrt(({x}) / 2)))"
    poly = "0e0"
    for c in reversed(_ERFC):
        poly = f"({c!r} + {t} * {poly})"
    one = f"(ln({t}) - ({x}) / 2 + {poly})"
    two = f"(-({x}) / 2)"
    three = f"({two} + ln(exp({one} - {two}) + sqrt(2 * ({x}) / pi())))"
    return f"(case {df} when 1 then {one} when 2 then {two} else {three} end / ln(10))"


def quality() -> str:
    """The site's score out of ``state_3``: the larger of the last step's and the global test's."""
    chi = "case when length(keep) = 1 and chi <= 0 then 2 * (lr - ref_ll) else chi end"
    last = f"case when x < 0 then 0 else least(100000, -10 * {log10_tail('x')}) end"
    over = f"least(10000, greatest(0, -10 * {log10_tail('y', 'df')}))"
    return f"""scored as (select *, cast(greatest(floor(greatest({last}, 0) + 0.5), floor({over} + 0.5)) as int) qual from (select *, {chi} x, greatest(0, 2 * (full_ll - ref_ll)) y, greatest(1, length(keep) - 1) df from state_3))"""


def listed(alleles: str, value: str) -> str:
    """Values of the alternatives in ``alleles`` (text of letters), each to four digits."""
    return f"list_aggregate(list_transform(list_filter(string_split({alleles}, ''), lambda l: l <> ''), lambda l: printf('%.4f', round({value}, 4))), 'string_agg', ',')"


FREQ = "case l when 'A' then fa when 'C' then fc when 'G' then fg else ft end"
