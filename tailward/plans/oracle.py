"""The same queries as plain SQL for DuckDB, written from the definitions and not from the Spark code."""

from __future__ import annotations

import re

from tailward.functions.normal import FAR_TAIL, INV_SQRT_2PI, LOWER, UPPER
from tailward.operators.features import FEATURES
from tailward.operators.tailrisk import POISSON
from tailward.operators.warnings import CUT_QUANTILES
from tailward.plans.products import SPLIT

TABLES: dict[str, str] = {}
ORACLES: dict[str, str] = {}


def rnd(expr: str, digits: int = 9, name: str | None = None) -> str:
    """Rounded value; adding zero turns -0.0 into 0.0."""
    return f"round({expr}, {digits}) + CAST(0 AS DOUBLE) AS {name or expr}"


def rnds(names: list[str], digits: int = 9) -> str:
    return ", ".join(rnd(n, digits) for n in names)


def table(name: str, sql: str) -> None:
    TABLES[name] = sql


def oracle(name: str, body: str) -> None:
    """Prefix ``body`` with the tables it names, directly or through other tables."""
    wanted: set[str] = set()
    texts = [body]
    while texts:
        words = set(re.findall(r"\w+", texts.pop())) & TABLES.keys()
        texts += [TABLES[w] for w in words - wanted]
        wanted |= words
    parts = [f"{t} AS ({sql})" for t, sql in TABLES.items() if t in wanted]
    recursive = "RECURSIVE " if any("UNION /* hops */" in TABLES[t] for t in wanted) else ""
    ORACLES[name] = (f"WITH {recursive}" + ",\n".join(parts) + "\n" if parts else "") + body


# Inputs

table(
    "quotes",
    """
SELECT s.event_id * 28 + (m.i + 3) * 4 + (CASE WHEN t.tenor = 30 THEN 0 ELSE 2 END) + p.c AS quote_id,
       s.ts, s.variety, s.fwd, t.tenor AS tenor_days, CASE WHEN p.c = 0 THEN 'C' ELSE 'P' END AS cp, m.i AS mny_idx,
       s.fwd * (CAST(1 AS DOUBLE) + CAST(m.i AS DOUBLE) / 20) AS strike,
       CAST(0.2 AS DOUBLE) + CAST(s.k AS DOUBLE) / 1000 - CAST(m.i AS DOUBLE) / 200 + CAST(m.i * m.i AS DOUBLE) / 1000
         + CASE WHEN t.tenor = 90 THEN CAST(0.01 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CAST(p.c AS DOUBLE) / 500 AS iv,
       CAST(1 + (s.event_id * 31 + (m.i + 3) * 17 + t.tenor + p.c * 41) % 97 AS BIGINT) AS volume,
       CAST(100 + (s.event_id * 7 + (m.i + 3) * 13 + t.tenor + p.c * 59) % 997 AS BIGINT) AS open_interest,
       CAST(1 + (s.event_id * 5 + m.i + 3) % 50 AS BIGINT) AS bid_size,
       CAST(1 + (s.event_id * 3 + (m.i + 3) * 7 + p.c * 11) % 50 AS BIGINT) AS ask_size,
       CAST((s.event_id * 11 + (m.i + 3) * 5 + p.c * 2 + t.tenor) % 3 - 1 AS INT) AS side,
       time_bucket(INTERVAL 15 MINUTES, s.ts) AS bar
FROM (SELECT event_id, ts, CAST(user_id % 6 AS INT) AS variety, CAST(100 AS DOUBLE) + value / 10 AS fwd,
             CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM events) s
CROSS JOIN (VALUES (-3), (-2), (-1), (0), (1), (2), (3)) m(i)
CROSS JOIN (VALUES (30), (90)) t(tenor)
CROSS JOIN (VALUES (0), (1)) p(c)""",
)
table(
    "quotes_b",
    """
SELECT *, time_bucket(INTERVAL 15 MINUTES, ts) AS bar FROM (
SELECT s.event_id * 28 + (m.i + 3) * 4 + t.t * 2 + p.c AS quote_id, s.ts, s.variety, s.fwd,
       CAST(CASE WHEN t.t = 0 THEN 20 + s.event_id % 3 * 7 ELSE 85 + s.event_id % 4 * 6 END AS INT) AS tenor_days,
       CASE WHEN p.c = 0 THEN 'C' ELSE 'P' END AS cp, m.i AS mny_idx,
       CASE WHEN s.event_id % 101 = 0 AND m.i = -3 THEN 0 ELSE s.fwd * (CAST(1 AS DOUBLE) + CAST(m.i AS DOUBLE) / 20) END AS strike,
       CASE WHEN NOT (s.event_id % 17 = 0 AND m.i = 2) THEN
         CAST(0.2 AS DOUBLE) + CAST(s.k AS DOUBLE) / 1000 - CAST(m.i * (1 + s.k % 7) AS DOUBLE) / 300
         + CAST(m.i * m.i * (1 + s.k % 5) AS DOUBLE) / 900 + CAST(t.t * (s.k % 11 - 5) AS DOUBLE) / 400 + CAST(p.c * (s.k % 3) AS DOUBLE) / 500 END AS iv,
       CAST(1 + (s.event_id * 31 + (m.i + 3) * 17 + t.t + p.c * 41) % 97 AS BIGINT) AS volume,
       CAST(100 + (s.event_id * 7 + (m.i + 3) * 13 + t.t + p.c * 59) % 997 AS BIGINT) AS open_interest,
       CAST(1 + (s.event_id * 5 + m.i + 3) % 50 AS BIGINT) AS bid_size,
       CAST(1 + (s.event_id * 3 + (m.i + 3) * 7 + p.c * 11) % 50 AS BIGINT) AS ask_size,
       CAST(CASE WHEN s.event_id % 13 = 0 THEN 1 ELSE (s.event_id * 11 + (m.i + 3) * 5 + p.c * 2 + t.t) % 3 - 1 END AS INT) AS side
FROM (SELECT event_id, CASE WHEN (hour(ts) * 2 + minute(ts) // 30) % 3 = 0 THEN ts + INTERVAL 30 MINUTES ELSE ts END AS ts,
             CAST(user_id % 6 AS INT) AS variety, CAST(100 AS DOUBLE) + value / 10 AS fwd,
             CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM events) s
CROSS JOIN (VALUES (-3), (-2), (-1), (0), (1), (2), (3)) m(i)
CROSS JOIN (VALUES (0), (1)) t(t)
CROSS JOIN (VALUES (0), (1)) p(c))""",
)
table(
    "exo",
    """
SELECT event_id AS src_id, CAST(user_id % 6 AS INT) AS variety, ts AS start_ts, ts + INTERVAL 1 HOUR AS end_ts,
       CASE WHEN CAST(regexp_extract(props, '[0-9]+', 0) AS INT) < 20 THEN 'named' ELSE 'market' END AS source
FROM events WHERE event_type = 'error' AND value >= 100""",
)
table(
    "macro_obs",
    """
SELECT CAST(ts AS DATE) AS obs_date, round(avg(value), 6) AS macro_index
FROM events WHERE event_type = 'signup' GROUP BY CAST(ts AS DATE)""",
)


# Prices and Greeks


def cdf(x: str) -> str:
    a = f"abs({x})"

    def poly(terms: tuple[float, ...]) -> str:
        return " + ".join(f"CAST({c!r} AS DOUBLE) * {a} ** {len(terms) - 1 - k}" for k, c in enumerate(terms))

    far = f"({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + CAST(0.65 AS DOUBLE))))))"
    near = f"exp(-{a} * {a} / 2) * ({poly(UPPER)}) / ({poly(LOWER)})"
    upper = f"CASE WHEN {a} < {FAR_TAIL} THEN {near} ELSE {pdf(x)} / {far} END"
    return f"CASE WHEN {x} >= 0 THEN 1 - ({upper}) ELSE {upper} END"


def pdf(x: str) -> str:
    return f"(CAST({INV_SQRT_2PI!r} AS DOUBLE) * exp(-({x}) * ({x}) / 2))"


def priced(source: str) -> str:
    return f"""
SELECT *, CASE WHEN cp = 'C' THEN fwd * n1 - strike * n2 ELSE strike * (1 - n2) - fwd * (1 - n1) END AS price,
       CASE WHEN cp = 'C' THEN n1 ELSE n1 - 1 END AS delta, {pdf("d1")} / (fwd * sd) AS gamma,
       fwd * {pdf("d1")} * years ** 0.5 AS vega, -fwd * {pdf("d1")} * iv / (2 * years ** 0.5) AS theta
FROM (SELECT *, {cdf("d1")} AS n1, {cdf("(d1 - sd)")} AS n2
      FROM (SELECT *, ln(fwd / nullif(strike, 0)) / sd + sd / 2 AS d1
            FROM (SELECT *, CAST(tenor_days AS DOUBLE) / 365 AS years, iv * sqrt(CAST(tenor_days AS DOUBLE) / 365) AS sd FROM {source})))"""


table("priced", priced("quotes"))
table("priced_b", priced("quotes_b"))


# Features


def feature_tables(tag: str, source: str) -> None:
    table(
        f"gaps{tag}",
        f"""
SELECT variety, bar, sum(gap * w) / sum(w) AS cp_gap FROM (
  SELECT variety, bar, sum(open_interest) FILTER (iv IS NOT NULL) AS w,
         sum(iv * open_interest) FILTER (cp = 'P') / sum(open_interest) FILTER (cp = 'P' AND iv IS NOT NULL)
         - sum(iv * open_interest) FILTER (cp = 'C') / sum(open_interest) FILTER (cp = 'C' AND iv IS NOT NULL) AS gap
  FROM {source} GROUP BY variety, bar, tenor_days, mny_idx)
WHERE gap IS NOT NULL GROUP BY variety, bar""",
    )
    put, call = "avg(iv) FILTER (tenor_days = near_days AND mny_idx = -2 AND cp = 'P')", "avg(iv) FILTER (tenor_days = near_days AND mny_idx = 2 AND cp = 'C')"
    near, far = "avg(iv) FILTER (tenor_days = near_days AND mny_idx = 0)", "avg(iv) FILTER (tenor_days = far_days AND mny_idx = 0)"
    table(
        f"per_bar{tag}",
        f"""
SELECT variety, bar, {near} AS atm_iv, {put} - {call} AS skew, ({put} + {call}) / 2 - {near} AS curvature,
       {far} - {near} AS term_slope,
       CAST(sum(volume * side) AS DOUBLE) / nullif(sum(volume), 0) AS signed_flow,
       CAST(coalesce(sum(volume) FILTER (cp = 'P'), 0) AS DOUBLE) / nullif(sum(volume) FILTER (cp = 'C'), 0) AS pc_volume,
       CAST(sum(bid_size - ask_size) AS DOUBLE) / nullif(sum(bid_size + ask_size), 0) AS depth_imbalance,
       CAST(sum(volume) AS DOUBLE) AS vol, CAST(sum(open_interest) AS DOUBLE) AS oi
FROM (SELECT *, min(tenor_days) FILTER (tenor_days >= 30) OVER (PARTITION BY variety, bar) AS near_days,
             min(tenor_days) FILTER (tenor_days >= 90) OVER (PARTITION BY variety, bar) AS far_days FROM {source})
GROUP BY variety, bar""",
    )
    table(
        f"features{tag}",
        f"""
SELECT p.variety, p.bar, atm_iv, skew, curvature, term_slope, cp_gap, atm_iv - lag(atm_iv) OVER w AS iv_change,
       signed_flow, pc_volume, depth_imbalance,
       vol / avg(vol) OVER (PARTITION BY p.variety ORDER BY p.bar ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS volume_surge,
       (oi - lag(oi) OVER w) / nullif(lag(oi) OVER w, 0) AS oi_change
FROM per_bar{tag} p LEFT JOIN gaps{tag} g ON p.variety = g.variety AND p.bar = g.bar
WINDOW w AS (PARTITION BY p.variety ORDER BY p.bar)""",
    )


feature_tables("", "quotes")
feature_tables("_b", "quotes_b")


def zscore(c: str) -> str:
    return f"""CASE WHEN count(*) OVER w >= 20 AND stddev_samp({c}) OVER w > 1e-9
            THEN ({c} - avg({c}) OVER w) / stddev_samp({c}) OVER w END AS z_{c}"""


for _tag in ("", "_b"):
    table(
        f"zscores{_tag}",
        f"""
SELECT *, {", ".join(zscore(c) for c in FEATURES)} FROM features{_tag}
WINDOW w AS (PARTITION BY variety ORDER BY bar ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""",
    )


def greek_tables(tag: str, source: str) -> None:
    table(
        f"atm{tag}",
        f"""
SELECT *, abs(strike - fwd) AS distance FROM {source}
QUALIFY row_number() OVER (PARTITION BY variety, bar, tenor_days, cp ORDER BY abs(strike - fwd), quote_id) = 1""",
    )
    table(f"atm_priced{tag}", priced(f"atm{tag}"))
    table(
        f"hhi{tag}",
        f"""
SELECT variety, bar, sum(w * w) / (sum(w) * sum(w)) AS hhi, count(*) FILTER (w > 0) AS n_parts
FROM (SELECT variety, bar, CAST(sum(open_interest) AS DOUBLE) AS w FROM {source} GROUP BY variety, bar, strike)
GROUP BY variety, bar""",
    )
    table(
        f"greek{tag}",
        f"""
SELECT h.variety, h.bar, h.hhi AS oi_hhi, delta_call, delta_put, gamma, vega, theta
FROM hhi{tag} h LEFT JOIN (
  SELECT variety, bar, max(delta) FILTER (cp = 'C') AS delta_call, max(delta) FILTER (cp = 'P') AS delta_put,
         avg(gamma) AS gamma, avg(vega) AS vega, avg(theta) AS theta
  FROM (SELECT * FROM atm_priced{tag} WHERE tenor_days >= 30 QUALIFY tenor_days = min(tenor_days) OVER (PARTITION BY variety, bar))
  GROUP BY variety, bar) a ON h.variety = a.variety AND h.bar = a.bar""",
    )


greek_tables("", "quotes")
greek_tables("_b", "quotes_b")

# Warnings

def level_tables(tag: str) -> None:
    sizes = " UNION ALL ".join(
        f"SELECT variety, bar, '{c}' AS feature, z_{c} AS z, round(abs(z_{c}), 6) AS size FROM zscores{tag}" for c in FEATURES
    )
    table(f"sizes{tag}", sizes)
    table(
        f"cuts{tag}",
        f"""
SELECT variety, feature, {", ".join(f"round(quantile_cont(size, {q}), 9) AS cut_{i + 1}" for i, q in enumerate(CUT_QUANTILES))}
FROM sizes{tag} WHERE bar < TIMESTAMP '{SPLIT}' GROUP BY variety, feature""",
    )
    table(
        f"scored{tag}",
        f"""
SELECT * REPLACE (CASE WHEN NOT no_cuts THEN level END AS level)
FROM (SELECT *, CAST(CASE WHEN hits_3 >= 2 THEN 3 WHEN hits_2 >= 2 THEN 2 WHEN hits_1 >= 2 THEN 1 ELSE 0 END AS INT) AS level
FROM (SELECT s.variety, s.bar, CAST(count(*) FILTER (size > cut_1) AS INT) AS hits_1,
             CAST(count(*) FILTER (size > cut_2) AS INT) AS hits_2, CAST(count(*) FILTER (size > cut_3) AS INT) AS hits_3,
             bool_and(c.variety IS NULL) AS no_cuts
      FROM sizes{tag} s LEFT JOIN cuts{tag} c ON s.variety = c.variety AND s.feature = c.feature GROUP BY s.variety, s.bar))""",
    )
    table(
        f"held{tag}",
        f"""
SELECT variety, bar, CASE WHEN lag(level) OVER w IS NULL THEN 0 ELSE least(level, lag(level) OVER w) END AS level
FROM scored{tag} WINDOW w AS (PARTITION BY variety ORDER BY bar)""",
    )


level_tables("")
level_tables("_b")


def runs(source: str, keys: str) -> str:
    return f"""
SELECT {keys}, min(bar) AS start_bar, max(bar) AS end_bar, count(*) AS n_bars, max(level) AS peak_level
FROM (SELECT *, sum(is_new) OVER (PARTITION BY {keys} ORDER BY bar) AS run
      FROM (SELECT *, CASE WHEN bar <= lag(bar) OVER (PARTITION BY {keys} ORDER BY bar) + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS is_new
            FROM {source} WHERE level >= 1))
GROUP BY {keys}, run"""


table("runs_held", runs("held", "variety"))


def islands(source: str) -> str:
    return f"""
SELECT variety, min(start_ts) AS start_ts, max(end_ts) AS end_ts, count(*) AS n_events,
       string_agg(DISTINCT source, ',' ORDER BY source) AS sources
FROM (SELECT *, sum(is_new) OVER (PARTITION BY variety ORDER BY start_ts, end_ts, source, src_id) AS island
      FROM (SELECT *, CASE WHEN start_ts <= max(end_ts) OVER (PARTITION BY variety ORDER BY start_ts, end_ts, source, src_id
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS is_new FROM {source}))
GROUP BY variety, island"""


table("fused", islands("exo"))
table("fused_system", islands("(SELECT src_id, -1 AS variety, start_ts, end_ts, source FROM exo)"))
LEAD = "CAST(date_diff('microsecond', warned_at, start_ts) AS DOUBLE) / 60000000"

# Two tracks, out of sample

table("at_levels", f"SELECT variety, bar, level, m.l AS min_level FROM held, (VALUES (1), (2), (3)) m(l) WHERE bar >= TIMESTAMP '{SPLIT}' AND level >= m.l")
table(
    "tracks",
    """
SELECT variety, bar, level, min_level FROM at_levels UNION ALL
SELECT -1, bar, max(level), min_level FROM at_levels GROUP BY bar, min_level HAVING count(*) >= 3""",
)
table("track_runs", runs("tracks", "min_level, variety"))
table(
    "track_events",
    f"""
SELECT variety, start_ts, end_ts, m.l AS min_level
FROM (SELECT variety, start_ts, end_ts FROM fused UNION ALL SELECT variety, start_ts, end_ts FROM fused_system), (VALUES (1), (2), (3)) m(l)
WHERE start_ts >= TIMESTAMP '{SPLIT}'""",
)
table(
    "track_pairs",
    """
SELECT w.min_level, w.variety, w.start_bar AS warned_at, e.start_ts FROM track_runs w JOIN track_events e
ON w.min_level = e.min_level AND w.variety = e.variety AND w.start_bar BETWEEN e.start_ts - INTERVAL 4 HOURS AND e.end_ts""",
)

# Adaptive

top = ", ".join(f"coalesce(round(abs(z_{c}), 6), 0)" for c in FEATURES)
table(
    "labelled",
    f"""
SELECT variety, bar, round(top / (top + 1), 6) AS score,
       CAST(EXISTS (SELECT 1 FROM exo e WHERE e.variety = z.variety AND e.start_ts > z.bar AND e.start_ts <= z.bar + INTERVAL 4 HOURS) AS INT) AS label
FROM (SELECT variety, bar, greatest({top}) AS top FROM zscores) z""",
)
table(
    "sweep",
    f"""
SELECT *, tp / nullif(CAST(tp + fp AS DOUBLE), 0) AS precision, tp / nullif(CAST(tp + fn AS DOUBLE), 0) AS recall,
       2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0) AS f1
FROM (SELECT variety, CAST(t.i AS DOUBLE) / 100 AS tau,
             count(*) FILTER (score >= CAST(t.i AS DOUBLE) / 100 AND label = 1) AS tp,
             count(*) FILTER (score >= CAST(t.i AS DOUBLE) / 100 AND label = 0) AS fp,
             count(*) FILTER (score < CAST(t.i AS DOUBLE) / 100 AND label = 1) AS fn
      FROM labelled, range(1, 100) t(i) WHERE bar < TIMESTAMP '{SPLIT}' GROUP BY variety, t.i)""",
)
table(
    "stars",
    """
SELECT variety, tau AS tau_star, f1 AS best_f1 FROM sweep
QUALIFY row_number() OVER (PARTITION BY variety ORDER BY round(f1, 9) DESC NULLS LAST, tau) = 1""",
)

# Tail risk

table(
    "bars",
    """
SELECT variety, bar, arg_min(fwd, (ts, quote_id)) AS open, max(fwd) AS high, min(fwd) AS low, arg_max(fwd, (ts, quote_id)) AS close,
       CAST(sum(volume) AS BIGINT) AS volume, count(*) AS n_rows FROM quotes GROUP BY variety, bar""",
)
table("bar_returns", "SELECT variety, bar, close, ln(close / lag(close) OVER (PARTITION BY variety ORDER BY bar)) AS ret FROM bars")
table(
    "daily",
    """
SELECT variety, day, ln(close / lag(close) OVER (PARTITION BY variety ORDER BY day)) AS ret
FROM (SELECT variety, CAST(ts AS DATE) AS day, arg_max(fwd, (ts, quote_id)) AS close FROM quotes GROUP BY ALL)""",
)
table("both_sides", "SELECT variety, 'long' AS side, -ret AS loss FROM bar_returns UNION ALL SELECT variety, 'short', ret FROM bar_returns")
table("daily_sides", "SELECT variety, 'long' AS side, -ret AS loss FROM daily UNION ALL SELECT variety, 'short', ret FROM daily")
table("alert_levels", "SELECT variety, CAST(bar AS DATE) AS day, max(level) AS day_level FROM held GROUP BY ALL")


def cvar(source: str, by: list[str], alphas: tuple[float, ...] = (0.95,)) -> str:
    keys = ", ".join(by)
    same = " AND ".join(f"k.{b} = v.{b}" for b in by)
    known = f"(SELECT {keys}, loss, round(loss, 9) AS x FROM {source} WHERE loss IS NOT NULL)"
    var = " UNION ALL ".join(
        f"SELECT {keys}, CAST({a} AS DOUBLE) AS alpha, round(quantile_cont(x, {a}), 12) AS var FROM {known} GROUP BY {keys}" for a in alphas
    )
    return f"""
SELECT {", ".join(f"v.{b}" for b in by)}, alpha, var, avg(loss) FILTER (x >= var) AS cvar, count(*) AS n_losses,
       count(*) FILTER (x >= var) AS n_tail
FROM ({var}) v JOIN {known} k ON {same} GROUP BY {", ".join(f"v.{b}" for b in by)}, alpha, var"""


def exposure(h: int, level: int) -> str:
    return f"""
SELECT d.variety, d.day, ret, day_level, {h} AS h, {level} AS level,
       CASE WHEN coalesce(max(day_level) OVER (PARTITION BY d.variety ORDER BY date_diff('day', DATE '1970-01-01', d.day)
            RANGE BETWEEN {h} PRECEDING AND 1 PRECEDING), 0) >= {level} THEN 0 ELSE 1 END AS exposure
FROM (SELECT coalesce(d.variety, a.variety) AS variety, coalesce(d.day, a.day) AS day, ret, day_level, d.day IS NOT NULL AS priced
      FROM daily d FULL JOIN alert_levels a ON d.variety = a.variety AND d.day = a.day) d QUALIFY priced"""


table("exposed", exposure(3, 2))
table("exposed_grid", " UNION ALL ".join(exposure(h, lv) for h in (1, 3, 5) for lv in (1, 2, 3)))


def books(source: str) -> str:
    return f"""
SELECT e.*, s.convention, s.side, b.book, e.ret * s.sign * CASE WHEN b.book = 'base' THEN 1 ELSE e.exposure END AS loss
FROM {source} e, (VALUES ('method', 'long', -1), ('competition', 'long', -1), ('competition', 'short', 1)) s(convention, side, sign),
     (VALUES ('base'), ('strategy')) b(book) WHERE e.ret IS NOT NULL"""


table("book_losses", books("exposed"))
table("book_grid", books("exposed_grid"))
table(
    "book_scopes",
    """
SELECT 'variety ' || variety AS scope, convention, side, book, loss FROM book_losses UNION ALL
SELECT 'week ' || CAST(CAST(date_trunc('week', day) AS DATE) AS VARCHAR), convention, side, book, loss FROM book_losses UNION ALL
SELECT 'overall', convention, side, book, loss FROM book_losses""",
)


def improved(source: str, by: list[str], alphas: tuple[float, ...] = (0.95,)) -> str:
    keys = ", ".join(by)
    return f"""
SELECT {keys}, alpha, cvar_base, cvar_strategy, 1 - cvar_strategy / nullif(cvar_base, 0) AS improvement
FROM (SELECT {keys}, alpha, max(cvar) FILTER (book = 'base') AS cvar_base, max(cvar) FILTER (book = 'strategy') AS cvar_strategy
      FROM ({cvar(source, [*by, "book"], alphas)}) GROUP BY {keys}, alpha)"""


# Graph

table("warned", "SELECT z.*, s.level FROM zscores z JOIN held s ON z.variety = s.variety AND z.bar = s.bar WHERE s.level >= 1")
for _tag in ("", "_b"):
    table(
        f"triggers{_tag}",
        f"""
SELECT s.variety, s.bar, s.feature, CASE WHEN z > 0 THEN 'up' ELSE 'down' END AS direction, size
FROM sizes{_tag} s JOIN cuts{_tag} c ON s.variety = c.variety AND s.feature = c.feature
JOIN held{_tag} l ON l.variety = s.variety AND l.bar = s.bar WHERE l.level >= 1 AND size > cut_1""",
    )
apart = " + ".join(f"(coalesce(a.z_{c}, 0) - coalesce(b.z_{c}, 0)) ** 2" for c in FEATURES)
table(
    "analogues",
    f"""
SELECT variety, bar, match_bar, distance, CAST(nth AS INT) AS nth FROM (
  SELECT a.variety, a.bar, b.bar AS match_bar, sqrt({apart}) AS distance,
         row_number() OVER (PARTITION BY a.variety, a.bar ORDER BY sqrt({apart}), b.bar) AS nth
  FROM warned a JOIN warned b ON a.variety = b.variety AND b.bar < a.bar) WHERE nth <= 5""",
)
PATTERN = """CASE WHEN z_skew > 2 THEN 'skew_steep' WHEN round(term_slope, 9) < 0 THEN 'term_inverted'
       WHEN z_curvature > 2 THEN 'wing_rich' WHEN round(abs(signed_flow), 9) > 0.5 THEN 'flow_shock' ELSE 'calm' END AS pattern"""
table(
    "macro_states",
    """
SELECT *, coalesce(round(macro_index - avg(macro_index) OVER (ORDER BY obs_date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) > 0, false) AS macro_high
FROM macro_obs""",
)
table(
    "concluded",
    f"""
SELECT b.*, CASE WHEN level = 3 THEN 'tail_risk' WHEN level = 2 AND coalesce(macro_high, false) THEN 'vol_up'
       WHEN level >= 1 THEN 'watch' ELSE 'none' END AS conclusion
FROM (SELECT q.variety, q.bar, q.level, q.pattern, m.obs_date, m.macro_index, m.macro_high
      FROM (SELECT z.variety, z.bar, s.level, {PATTERN} FROM zscores z JOIN held s ON z.variety = s.variety AND z.bar = s.bar) q
      ASOF LEFT JOIN macro_states m ON CAST(q.bar AS DATE) > m.obs_date) b""",
)
table("explained", "SELECT * FROM concluded WHERE level >= 1")


def moment(bar: str, variety: str = "variety") -> str:
    return f"concat_ws('|', {variety}, strftime({bar}, '%Y-%m-%d %H:%M:%S'))"


def node(kind: str, key: str) -> str:
    return f"md5('{kind}|' || {key})"


TRIGGER_KEY = "concat_ws('|', t.variety, t.feature, t.direction)"
table(
    "nodes",
    f"""
SELECT DISTINCT md5(type || '|' || key) AS id, type, key FROM (
  SELECT 'warning' AS type, {moment("bar")} AS key FROM explained UNION ALL
  SELECT 'trigger', {TRIGGER_KEY} FROM triggers t UNION ALL
  SELECT 'pattern', pattern FROM explained UNION ALL
  SELECT 'analogue', {moment("match_bar")} FROM analogues UNION ALL
  SELECT 'macro', CAST(obs_date AS VARCHAR) FROM explained UNION ALL
  SELECT 'conclusion', conclusion FROM explained) WHERE key IS NOT NULL""",
)
def edge_sql(triggers: str) -> str:
    return f"""
SELECT src, dst, relation, count(*) AS weight FROM (
  SELECT {node("warning", moment("bar"))} AS src, {node("trigger", TRIGGER_KEY)} AS dst, 'triggered_by' AS relation FROM {triggers} t UNION ALL
  SELECT {node("trigger", TRIGGER_KEY)}, {node("pattern", "pattern")}, 'shapes'
    FROM {triggers} t JOIN explained e ON t.variety = e.variety AND t.bar = e.bar UNION ALL
  SELECT {node("warning", moment("bar"))}, {node("analogue", moment("match_bar"))}, 'resembles' FROM analogues UNION ALL
  SELECT {node("warning", moment("bar"))}, {node("macro", "CAST(obs_date AS VARCHAR)")}, 'under_macro' FROM explained WHERE obs_date IS NOT NULL UNION ALL
  SELECT {node("pattern", "pattern")}, {node("conclusion", "conclusion")}, 'concludes' FROM explained)
GROUP BY src, dst, relation"""


table("edges", edge_sql("triggers"))
table(
    "reach",
    f"""
SELECT {node("warning", moment("bar"))} AS id, 0 AS hops FROM explained WHERE level = 3
UNION /* hops */ SELECT e.dst, r.hops + 1 FROM reach r JOIN edges e ON r.id = e.src WHERE r.hops < 3""",
)

# Sources and sinks

oracle(
    "s1_read_archive",
    """SELECT CASE variety % 4 WHEN 0 THEN 'SF' WHEN 1 THEN 'INE' WHEN 2 THEN 'DF' ELSE 'GF' END AS exchange, variety, count(*) AS n_rows,
count(DISTINCT quote_id) AS n_ids, CAST(sum(volume) AS BIGINT) AS volume, min(ts) AS first_ts, max(ts) AS last_ts FROM quotes GROUP BY ALL""",
)
oracle("s2_write_features", f"SELECT variety, bar, {rnds(FEATURES)} FROM features")
oracle(
    "s3_write_metrics",
    f"SELECT variety, side, alpha, {rnd('var', 12)}, {rnd('cvar')}, n_losses, n_tail FROM ({cvar('daily_sides', ['variety', 'side'])})",
)
oracle(
    "s4_write_graph",
    "SELECT 'node' AS part, id, type AS kind, NULL::VARCHAR AS dst FROM nodes UNION ALL SELECT 'edge', src, relation, dst FROM edges",
)

# Profiling and quality

PROFILED = ["fwd", "strike", "iv", "volume", "open_interest", "bid_size", "ask_size"]
oracle(
    "p1_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n_values, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct,
{rnd(f"CAST(min({c}) AS DOUBLE)", 6, "min_value")}, {rnd(f"CAST(max({c}) AS DOUBLE)", 6, "max_value")},
{rnd(f"avg({c})", 6, "mean_value")}, {rnd(f"CAST(quantile_cont({c}, 0.5) AS DOUBLE)", 6, "p50")} FROM quotes"""
        for c in PROFILED
    ),
)
GRID = """(SELECT variety, unnest(generate_series(lo, hi + INTERVAL 1425 MINUTES, INTERVAL 15 MINUTES)) AS bar
FROM (SELECT variety, CAST(CAST(min(ts) AS DATE) AS TIMESTAMP) AS lo, CAST(CAST(max(ts) AS DATE) AS TIMESTAMP) AS hi FROM quotes GROUP BY variety)) g"""
SEEN = "(SELECT DISTINCT variety, bar FROM quotes) q ON g.variety = q.variety AND g.bar = q.bar"
oracle(
    "p2_coverage",
    f"""SELECT g.variety, CAST(g.bar AS DATE) AS day, count(q.bar) AS n_present, count(*) - count(q.bar) AS n_missing
FROM {GRID} LEFT JOIN {SEEN} GROUP BY ALL""",
)
oracle("p2_missing_bars", f"SELECT g.variety, CAST(g.bar AS DATE) AS day, g.bar FROM {GRID} LEFT JOIN {SEEN} WHERE q.bar IS NULL")
WEEK = "(VALUES (540, 690), (810, 900), (1260, 1500)) h(o, c)"
table(
    "open_bars",
    f"""
SELECT variety, bar, CAST(row_number() OVER (PARTITION BY variety ORDER BY bar) - 1 AS INT) AS ordinal FROM (
    SELECT DISTINCT variety, unnest(range(day + o * INTERVAL 1 MINUTE, day + c * INTERVAL 1 MINUTE, INTERVAL 15 MINUTES)) AS bar
    FROM (SELECT DISTINCT variety, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day FROM quotes) CROSS JOIN {WEEK}
    WHERE isodow(day) <= 5 AND (o < 1260 OR variety % 2 = 0))""",
)
BARS_SEEN = "(SELECT DISTINCT variety, bar FROM quotes) q"
oracle(
    "p2_session_coverage",
    f"""SELECT coalesce(g.variety, q.variety) AS variety, CAST(coalesce(g.bar, q.bar) AS DATE) AS day,
    count(*) FILTER (g.bar IS NOT NULL AND q.bar IS NOT NULL) AS n_present, count(*) FILTER (q.bar IS NULL) AS n_missing, count(*) FILTER (g.bar IS NULL) AS n_outside
FROM open_bars g FULL JOIN {BARS_SEEN} ON g.variety = q.variety AND g.bar = q.bar GROUP BY ALL""",
)
oracle(
    "p2_missing_open_bars",
    f"SELECT g.variety, CAST(g.bar AS DATE) AS day, g.bar FROM open_bars g LEFT JOIN {BARS_SEEN} ON g.variety = q.variety AND g.bar = q.bar WHERE q.bar IS NULL",
)
table("kept", "SELECT * FROM quotes WHERE tenor_days > 0 AND open_interest >= 110 AND bid_size + ask_size >= 6")
feature_tables("_kept", "kept")
for _name, _other in (("p3_align_quality", "features_kept"), ("p3b_align_quality", "features_b")):
    oracle(_name, " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER (a.variety IS NOT NULL AND b.variety IS NOT NULL) AS n_matched,
count(*) FILTER (b.variety IS NULL) AS n_left_only, count(*) FILTER (a.variety IS NULL) AS n_right_only, count(a.{c} - b.{c}) AS n_compared,
count(*) FILTER (abs(a.{c} - b.{c}) <= 1e-6) AS n_within, {rnd(f"max(abs(a.{c} - b.{c}))", 6, "max_abs_diff")}
FROM features a FULL JOIN {_other} b ON a.variety = b.variety AND a.bar = b.bar"""
        for c in FEATURES
    ))
BROKEN = {
    "price_unknown": "(price IS NULL OR isnan(price))",
    "price_not_positive": "price <= 0",
    "expired": "tenor_days <= 0",
    "thin_open_interest": "open_interest < 110",
    "thin_book": "bid_size + ask_size < 6",
}
NONE_BROKEN = " AND ".join(f"coalesce(NOT ({r}), true)" for r in BROKEN.values())
for _name, _source in (("p4_validate", "priced"), ("p4b_validate", "priced_b")):
    oracle(
        _name,
        " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER ({r}) AS n_rows FROM {_source}" for n, r in BROKEN.items())
        + f" UNION ALL SELECT '(clean)', count(*) FILTER ({NONE_BROKEN}) FROM {_source}",
    )
oracle(
    "p4_violations",
    " UNION ALL ".join(f"SELECT quote_id, '{n}' AS rule FROM priced WHERE {r}" for n, r in BROKEN.items()),
)
oracle(
    "p5_dedup_latest",
    """SELECT variety, tenor_days, mny_idx, cp, bar, quote_id, ts FROM quotes
QUALIFY row_number() OVER (PARTITION BY variety, tenor_days, mny_idx, cp, bar ORDER BY ts DESC, quote_id DESC) = 1""",
)

# Bars, volatility and features

oracle("f1_to_bars", "SELECT * FROM bars")
oracle("f2_black76_price", f"SELECT quote_id, {rnd('price', 6)} FROM priced")
oracle("f3_implied_vol", f"SELECT quote_id, {rnd('iv', 6)} FROM quotes")
oracle(
    "f4_iv_surface",
    f"""SELECT variety, bar, tenor_days, mny_idx, cp, {rnd("sum(iv * open_interest) / sum(open_interest)", 9, "iv")},
CAST(sum(open_interest) AS BIGINT) AS open_interest FROM quotes GROUP BY variety, bar, tenor_days, mny_idx, cp""",
)
for _i, _c in enumerate(FEATURES, start=5):
    oracle(f"f{_i}_feat_{_c}", f"SELECT variety, bar, {rnd(_c)} FROM features")
oracle("f16_build_features", f"SELECT variety, bar, {rnds(FEATURES)} FROM features")
oracle("f17_rolling_zscore", f"SELECT variety, bar, {rnds([f'z_{c}' for c in FEATURES], 6)} FROM zscores")

# Greeks

GREEKS = ["delta", "gamma", "vega", "theta"]
GREEK_COLUMNS = ["oi_hhi", "delta_call", "delta_put", "gamma", "vega", "theta"]
oracle("g1_select_atm", f"SELECT variety, bar, tenor_days, cp, quote_id, {rnds(['distance', 'iv'])} FROM atm")
oracle("g2_greeks", f"SELECT quote_id, {rnds(GREEKS, 6)} FROM priced")
oracle("g3_hhi", f"SELECT variety, bar, {rnd('hhi')}, n_parts FROM hhi")
oracle("g4_build_greeks", f"SELECT variety, bar, {rnds(GREEK_COLUMNS, 6)} FROM greek")
oracle(
    "g5_join_features",
    f"""SELECT coalesce(f.variety, g.variety) AS variety, coalesce(f.bar, g.bar) AS bar, {rnds(FEATURES + GREEK_COLUMNS, 6)},
f.variety IS NOT NULL AS has_features, g.variety IS NOT NULL AS has_greeks
FROM features f FULL JOIN greek_b g ON f.variety = g.variety AND f.bar = g.bar""",
)

# Events

oracle("e1_fuse_events", "SELECT * FROM fused")
oracle("e2_label_bars", "SELECT variety, bar, label FROM labelled")
oracle(
    "e2_session_labels",
    """SELECT variety, bar, CASE WHEN ordinal IS NOT NULL THEN CAST(EXISTS (
        SELECT 1 FROM exo x WHERE x.variety = b.variety AND x.start_ts > b.bar AND (b.last IS NULL OR x.start_ts <= b.last)) AS INT) END AS label
FROM (SELECT q.variety, q.bar, o.ordinal, e.bar AS last FROM (SELECT DISTINCT variety, bar FROM quotes) q
      LEFT JOIN open_bars o ON o.variety = q.variety AND o.bar = q.bar LEFT JOIN open_bars e ON e.variety = o.variety AND e.ordinal = o.ordinal + 16) b""",
)
oracle(
    "e3_event_coverage",
    """SELECT variety, source, min(start_ts) AS first_start, max(start_ts) AS last_start, count(start_ts) AS n_events
FROM (SELECT v.variety, s.source FROM (SELECT DISTINCT variety FROM quotes) v CROSS JOIN (VALUES ('named'), ('market')) s(source))
FULL JOIN exo USING (variety, source) GROUP BY ALL""",
)

# Rule warnings and backtest

oracle("w1_calibrate", "SELECT * FROM cuts")
# A sketch keeps all values while they are few, as in each variety here, so its cuts are the discrete quantiles.
DISCRETE = ", ".join(rnd(f"quantile_disc(size, {q})", 9, f"cut_{i}") for i, q in enumerate(CUT_QUANTILES, 1))
oracle("w1_calibrate_sketched", f"SELECT variety, feature, {DISCRETE} FROM sizes WHERE bar < TIMESTAMP '{SPLIT}' GROUP BY variety, feature")
oracle("w2_score_levels", "SELECT * FROM scored")
oracle("w3_debounce", "SELECT * FROM held")
oracle("w4_episodes", runs("held", "variety"))
oracle(
    "w4_session_episodes",
    """SELECT variety, min(bar) AS start_bar, max(bar) AS end_bar, count(*) AS n_bars, max(level) AS peak_level
FROM (SELECT *, sum(CASE WHEN last IS NULL OR ordinal > last + 2 THEN 1 ELSE 0 END) OVER (PARTITION BY variety ORDER BY bar) AS run
      FROM (SELECT h.variety, h.bar, h.level, o.ordinal, lag(o.ordinal) OVER (PARTITION BY h.variety ORDER BY h.bar) AS last
            FROM held h JOIN open_bars o ON o.variety = h.variety AND o.bar = h.bar WHERE h.level >= 1))
GROUP BY variety, run""",
)
oracle(
    "w5_systemic",
    "SELECT bar, count(*) FILTER (level >= 1) AS n_varieties, count(*) FILTER (level >= 1) >= 3 AS is_systemic FROM held GROUP BY bar",
)
oracle(
    "w6_match_events",
    f"""SELECT variety, warned_at, start_ts, end_ts, {rnd(LEAD, 6, "lead_minutes")},
round(max({LEAD}) OVER (PARTITION BY variety, start_ts, end_ts), 6) AS first_lead_minutes
FROM (SELECT w.variety, w.start_bar AS warned_at, e.start_ts, e.end_ts FROM runs_held w JOIN fused e
      ON w.variety = e.variety AND w.start_bar BETWEEN e.start_ts - INTERVAL 4 HOURS AND e.end_ts)""",
)
TRACK = "CASE WHEN variety = -1 THEN 'system' ELSE 'variety' END AS track"
oracle(
    "w7_backtest",
    f"""SELECT track, min_level, n_warnings, n_matched_warnings, n_events, n_matched_events, {rnd("p", 6, "precision")}, {rnd("r", 6, "recall")},
{rnd("2 * p * r / nullif(p + r, 0)", 6, "f1")}, {rnd("mean_lead_minutes", 6)}
FROM (SELECT *, n_matched_warnings / nullif(CAST(n_warnings AS DOUBLE), 0) AS p, n_matched_events / nullif(CAST(n_events AS DOUBLE), 0) AS r
FROM (SELECT track, min_level, coalesce(n_warnings, 0) AS n_warnings, coalesce(n_matched_warnings, 0) AS n_matched_warnings, n_events,
      coalesce(n_matched_events, 0) AS n_matched_events, mean_lead_minutes
FROM (SELECT {TRACK}, min_level, count(*) AS n_events FROM track_events GROUP BY ALL)
LEFT JOIN (SELECT {TRACK}, min_level, count(*) AS n_warnings FROM track_runs GROUP BY ALL) USING (track, min_level)
LEFT JOIN (SELECT {TRACK}, min_level, count(DISTINCT (variety, warned_at)) AS n_matched_warnings FROM track_pairs GROUP BY ALL) USING (track, min_level)
LEFT JOIN (SELECT track, min_level, count(*) AS n_matched_events, avg(lead) AS mean_lead_minutes
           FROM (SELECT {TRACK}, min_level, variety, start_ts, max({LEAD}) AS lead FROM track_pairs GROUP BY ALL) GROUP BY ALL) USING (track, min_level)))""",
)

# Adaptive warnings (fitting and scoring a model have no SQL form)

oracle("a3_tau_sweep", f"SELECT variety, tau, tp, fp, fn, {rnds(['precision', 'recall', 'f1'])} FROM sweep")
oracle("a4_tau_star", f"SELECT variety, tau_star, {rnd('best_f1')} FROM stars")
LATER = f"bar >= TIMESTAMP '{SPLIT}'"
oracle(
    "a5_double_confirm",
    f"""SELECT l.variety, l.bar, l.score, s.level AS rule_level, t.tau_star, l.score >= t.tau_star AND s.level >= 1 AS alert
FROM labelled l JOIN held s ON l.variety = s.variety AND l.bar = s.bar JOIN stars t ON t.variety = l.variety WHERE l.{LATER}""",
)
F1 = "2 * count(*) FILTER ({a} AND label = 1) / nullif(CAST(count(*) FILTER ({a}) + count(*) FILTER (label = 1) AS DOUBLE), 0)"
oracle(
    "a6_f1_gain",
    f"""SELECT {rnds(["f1_adaptive", "f1_fixed"], 6)}, {rnd("f1_adaptive / nullif(f1_fixed, 0) - 1", 6, "gain")}
FROM (SELECT {F1.format(a="score >= tau_star")} AS f1_adaptive, {F1.format(a="score >= 0.5")} AS f1_fixed
      FROM labelled l JOIN stars t ON l.variety = t.variety WHERE {LATER})""",
)

# Tail risk

MEASURES = "alpha, " + rnd("var", 12) + ", " + rnd("cvar") + ", n_losses, n_tail"
oracle("c1_log_returns", f"SELECT variety, bar, close, {rnd('ret')} FROM bar_returns")
table("long_losses", "SELECT variety, -ret AS loss FROM bar_returns")
oracle("c2_cvar", f"SELECT variety, {MEASURES} FROM ({cvar('long_losses', ['variety'])})")
oracle("c3_dual_side", f"SELECT side, {MEASURES} FROM ({cvar('both_sides', ['side'])})")
oracle("c4_de_expose", f"SELECT variety, day, {rnd('ret')}, day_level, exposure, {rnd('ret * exposure', 9, 'strategy_ret')} FROM exposed")
IMPROVEMENT = "alpha, " + rnds(["cvar_base", "cvar_strategy", "improvement"], 6)
oracle(
    "c5_cvar_improvement",
    f"""SELECT convention, side, {IMPROVEMENT}, coalesce(round(improvement, 9) > 0.1, false) AS meets_target
FROM ({improved("book_losses", ["convention", "side"])})""",
)
oracle(
    "c6_robust_grid",
    f"SELECT h, level, convention, side, {IMPROVEMENT} FROM ({improved('book_grid', ['h', 'level', 'convention', 'side'], (0.90, 0.95, 0.99))})",
)
TAKEN = " + ".join(f"CAST(u >= {c!r} AS INT)" for c in POISSON)
table(
    "book_drawn",
    f"""
SELECT b.convention, b.side, b.book, w.draw, b.loss FROM book_losses b JOIN (
    SELECT block, draw, {TAKEN} AS weight FROM (
        SELECT block, draw, CAST('0x' || sha256('1:' || block || ':' || draw)[1:8] AS BIGINT) / 4294967296.0::DOUBLE AS u
        FROM (SELECT DISTINCT CAST(floor((day - DATE '1970-01-01') / 5) AS INT) AS block FROM book_losses) CROSS JOIN range(200) d(draw))
) w ON w.block = CAST(floor((b.day - DATE '1970-01-01') / 5) AS INT) CROSS JOIN range(30) r(k) WHERE r.k < w.weight""",
)
oracle(
    "c6_block_bootstrap",
    f"""SELECT convention, side, count(improvement) AS n_draws, {rnd("quantile_cont(improvement, 0.05)", 6, "low")}, {rnd("quantile_cont(improvement, 0.5)", 6, "median")},
    {rnd("quantile_cont(improvement, 0.95)", 6, "high")}, {rnd("avg(CAST(round(improvement, 9) > 0.1 AS INT))", 6, "share_above")}
FROM ({improved("book_drawn", ["convention", "side", "draw"])}) GROUP BY convention, side""",
)
oracle("c7_robust_subperiod", f"SELECT scope, convention, side, {IMPROVEMENT} FROM ({improved('book_scopes', ['scope', 'convention', 'side'])})")

# Knowledge graph

oracle("k1_kg_nodes", "SELECT * FROM nodes")
oracle("k2_trigger_edges", "SELECT * FROM triggers")
oracle("k3_similar_history", f"SELECT variety, bar, match_bar, {rnd('distance', 6)}, nth FROM analogues")
oracle("k4_macro_asof", "SELECT b.variety, b.bar, m.obs_date, m.macro_index FROM bars b ASOF LEFT JOIN macro_obs m ON CAST(b.bar AS DATE) > m.obs_date")
oracle(
    "k4_quote_asof",
    """SELECT x.src_id, x.variety, x.start_ts, q.ts AS quoted_at, q.fwd
FROM exo x ASOF LEFT JOIN (SELECT variety, ts, max(fwd) AS fwd FROM quotes GROUP BY ALL) q ON x.variety = q.variety AND x.start_ts >= q.ts""",
)
oracle("k5_market_pattern", "SELECT variety, bar, pattern FROM concluded")
oracle("k6_conclude", "SELECT variety, bar, level, obs_date, macro_high, conclusion FROM concluded")
oracle("k7_kg_edges", "SELECT * FROM edges")
oracle(
    "k8_attribution_path",
    """SELECT variety, bar, CAST(row_number() OVER (PARTITION BY variety, bar ORDER BY layer, item) AS INT) AS step_no, layer, kind, item FROM (
  SELECT variety, bar, 1 AS layer, 'trigger' AS kind, feature || ' ' || direction AS item FROM triggers UNION ALL
  SELECT variety, bar, 2, 'pattern', pattern FROM explained UNION ALL
  SELECT variety, bar, 3, 'analogue', strftime(match_bar, '%Y-%m-%d %H:%M:%S') FROM analogues UNION ALL
  SELECT variety, bar, 4, 'macro', CAST(obs_date AS VARCHAR) FROM explained WHERE obs_date IS NOT NULL UNION ALL
  SELECT variety, bar, 5, 'conclusion', conclusion FROM explained)""",
)
oracle(
    "k9_trace",
    "SELECT r.id, n.type, r.hops FROM (SELECT id, min(hops) AS hops FROM reach GROUP BY id) r JOIN nodes n ON n.id = r.id",
)
table("route0", "SELECT DISTINCT id, id AS route FROM reach WHERE hops = 0")
for _hop in (1, 2, 3):
    _seen = " AND ".join(f"e.dst NOT IN (SELECT id FROM route{k})" for k in range(_hop))
    table(
        f"route{_hop}",
        f"""SELECT e.dst AS id, r.route || ' -' || e.relation || '> ' || e.dst AS route FROM edges e JOIN route{_hop - 1} r ON r.id = e.src
WHERE {_seen} QUALIFY row_number() OVER (PARTITION BY e.dst ORDER BY e.src, e.relation) = 1""",
    )
ROUTES = " UNION ALL ".join(f"SELECT id, CAST({k} AS INT) AS hops, route FROM route{k}" for k in range(4))
oracle("k9_trace_routes", f"SELECT r.id, n.type, r.hops, r.route FROM ({ROUTES}) r JOIN nodes n ON n.id = r.id")
DEGREES = """(SELECT id, CAST(sum(o) AS BIGINT) AS o, CAST(sum(i) AS BIGINT) AS i FROM (SELECT src AS id, 1 AS o, 0 AS i FROM edges
UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY id)"""
oracle(
    "k10_kg_stats",
    f"""SELECT 'node' AS part, coalesce(type, '(all)') AS type, count(*) AS n, NULL::BIGINT AS total_weight,
{rnd("avg(coalesce(o, 0) + coalesce(i, 0))", 6, "mean_degree")}, max(coalesce(o, 0)) AS max_out, max(coalesce(i, 0)) AS max_in
FROM nodes LEFT JOIN {DEGREES} d USING (id) GROUP BY ROLLUP (type) UNION ALL
SELECT 'edge', coalesce(relation, '(all)'), count(*), CAST(sum(weight) AS BIGINT), NULL, NULL, NULL FROM edges GROUP BY ROLLUP (relation)""",
)
table("other_edges", edge_sql("triggers_b"))
oracle(
    "k11_kg_audit",
    """SELECT 'missing_source' AS problem, src, dst FROM other_edges WHERE src NOT IN (SELECT id FROM nodes) UNION ALL
SELECT 'missing_target', src, dst FROM other_edges WHERE dst NOT IN (SELECT id FROM nodes) UNION ALL
SELECT 'node_without_edge', id, NULL FROM nodes WHERE id NOT IN (SELECT src FROM other_edges UNION SELECT dst FROM other_edges)""",
)
oracle(
    "k12_stratified_sample",
    f"""SELECT variety, level, bar, CAST(nth AS INT) AS sample_no FROM (SELECT *, row_number() OVER (PARTITION BY variety, level
ORDER BY md5({moment("bar")}), {moment("bar")}) AS nth FROM explained) WHERE nth <= 2""",
)

# Tables behind the dashboard

oracle(
    "v1_level_heatmap",
    "SELECT CAST(bar AS DATE) AS day, variety, max(level) AS peak_level FROM held GROUP BY ALL",
)
oracle("v2_latest_status", "SELECT variety, max(bar) AS bar, arg_max(level, bar) AS level FROM held GROUP BY variety")
oracle("v3_top_warnings", "SELECT * FROM runs_held ORDER BY peak_level DESC, n_bars DESC, start_bar, variety LIMIT 10")
oracle(
    "v4_level_counts",
    "SELECT variety, level, count(*) AS n_bars, CAST(grouping(variety, level) AS INT) AS grouping_level FROM held GROUP BY ROLLUP (variety, level)",
)

# The second derived quote table

oracle("f2b_black76_price", f"SELECT quote_id, {rnd('price', 6)} FROM priced_b")
for _c in ("atm_iv", "skew", "curvature", "term_slope"):
    oracle(f"f{5 + FEATURES.index(_c)}b_feat_{_c}", f"SELECT variety, bar, {rnd(_c)} FROM features_b")
oracle("f16b_build_features", f"SELECT variety, bar, {rnds(FEATURES)} FROM features_b")
oracle("f17b_rolling_zscore", f"SELECT variety, bar, {rnds([f'z_{c}' for c in FEATURES], 6)} FROM zscores_b")
oracle("g4b_build_greeks", f"SELECT variety, bar, {rnds(GREEK_COLUMNS, 6)} FROM greek_b")
oracle("k5b_market_pattern", f"SELECT variety, bar, {PATTERN} FROM zscores_b")

# The fitted model: what must hold of it, as its weights have no SQL form

oracle(
    "a1_bc_gradient",
    " UNION ALL ".join(
        [f"SELECT '{c}' AS feature, true AS at_optimum FROM zscores WHERE bar < TIMESTAMP '{SPLIT}' HAVING count(z_{c}) > 0" for c in FEATURES]
        + ["SELECT '(intercept)', true"]
    ),
)
oracle("a2_bc_score_by_weights", f"SELECT variety, bar, true AS agrees FROM zscores WHERE {LATER}")
oracle(
    "a5_adaptive_rule",
    f"SELECT variety, bar, level AS rule_level, true AS follows_rule FROM held JOIN (SELECT DISTINCT variety FROM stars) USING (variety) WHERE {LATER}",
)
