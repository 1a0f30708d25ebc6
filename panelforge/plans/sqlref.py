"""SQL of the engine's queries for DuckDB, as chains of named parts over the same tables."""

from __future__ import annotations

PRICES = {
    "brand": "SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, p_brand AS asset, sum(l_extendedprice) / sum(l_quantity) AS price FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "flag": "SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_returnflag || l_linestatus AS asset, sum(l_extendedprice) / sum(l_quantity) AS price FROM lineitem GROUP BY 1, 2",
    "nation": "SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, n_name AS asset, sum(l_extendedprice) / sum(l_quantity) AS price FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2",
    "region": "SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, r_name AS asset, sum(l_extendedprice) / sum(l_quantity) AS price FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
    "priority": "SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS date, o_orderpriority AS asset, avg(o_totalprice) AS price FROM orders GROUP BY 1, 2",
}

#: Parts by name; {panel}, {look}, {step} are filled in. A part may use those before it.
PARTS = {
    "px": "{panel}",
    "di": "SELECT date, row_number() OVER (ORDER BY date) - 1 AS di FROM (SELECT DISTINCT date FROM px)",
    "ai": "SELECT asset, row_number() OVER (ORDER BY asset) - 1 AS asset_idx FROM (SELECT DISTINCT asset FROM px)",
    "mv": "SELECT px.date, di, px.asset, price, CASE WHEN lag(di) OVER w = di - 1 THEN price / lag(price) OVER w - 1 END AS ret FROM px JOIN di ON px.date = di.date WINDOW w AS (PARTITION BY px.asset ORDER BY di)",
    "fl": "SELECT date, row_number() OVER (ORDER BY date) - 1 AS row_idx FROM (SELECT date FROM mv GROUP BY date HAVING count(ret) = (SELECT count(*) FROM ai))",
    "rt": "SELECT row_idx, mv.date, mv.asset, asset_idx, ret FROM mv JOIN fl ON mv.date = fl.date JOIN ai ON mv.asset = ai.asset",
    "fd": "SELECT i AS fold_id, i * {step} AS train_lo, {look} + i * {step} AS train_hi, {look} + i * {step} AS test_lo, {look} + (i + 1) * {step} AS test_hi FROM (SELECT unnest(range(0, greatest(0, ((SELECT count(DISTINCT row_idx) FROM rt) - {look}) // {step}))) AS i)",
    "tr": "SELECT fold_id, train_lo, train_hi, rt.* FROM rt JOIN fd ON row_idx >= train_lo AND row_idx < train_hi",
    "te": "SELECT fold_id, test_lo, test_hi, rt.* FROM rt JOIN fd ON row_idx >= test_lo AND row_idx < test_hi",
    "sd": "SELECT fold_id, asset, stddev_samp(ret) AS sd FROM tr GROUP BY fold_id, asset",
    "iv": "SELECT fold_id, asset, (1 / sd) / sum(1 / sd) OVER (PARTITION BY fold_id) AS w FROM sd",
    "ew": "SELECT DISTINCT fold_id, asset, 1.0 / (SELECT count(*) FROM ai) AS w FROM tr",
    "hd": "SELECT te.fold_id, te.row_idx, te.date, te.asset, te.ret, iv.w FROM te JOIN iv ON te.fold_id = iv.fold_id AND te.asset = iv.asset",
    "rb": "SELECT fold_id, row_idx, sum(w * ret) AS gross FROM hd GROUP BY fold_id, row_idx",
    "dr": "SELECT hd.*, gross, w * (1 + ret) / (1 + gross) AS moved FROM hd JOIN rb ON hd.fold_id = rb.fold_id AND hd.row_idx = rb.row_idx",
    "tv": "SELECT fold_id, row_idx, gross, coalesce(sum(abs(w - before)), 0.0) AS turnover FROM (SELECT *, lag(moved) OVER (PARTITION BY fold_id, asset ORDER BY row_idx) AS before FROM dr) GROUP BY fold_id, row_idx, gross",
    "sh": "SELECT *, w * product(1 + ret) OVER (PARTITION BY fold_id, asset ORDER BY row_idx) AS share FROM hd",
    "wl": "SELECT fold_id, row_idx, sum(share) AS wealth FROM sh GROUP BY fold_id, row_idx",
    "pf": """SELECT fold_id, count(*) AS n, avg(gross) * 252 AS annual_mean, stddev_samp(gross) * sqrt(252) AS annual_vol, exp(sum(ln(1 + gross))) - 1 AS cumulative,
  exp(sum(ln(1 + gross)) * 252 / count(*)) - 1 AS cagr, avg(gross) / stddev_samp(gross) * sqrt(252) AS sharpe FROM rb GROUP BY fold_id""",
    "dd": """SELECT fold_id, greatest(max(1 - wealth / greatest(high, 1.0)), 0.0) AS max_dd_geo, max(top - total) AS max_dd_arith FROM (
  SELECT *, max(wealth) OVER w AS high, max(total) OVER w AS top FROM (SELECT fold_id, row_idx, product(1 + gross) OVER w AS wealth, sum(gross) OVER w AS total FROM rb WINDOW w AS (PARTITION BY fold_id ORDER BY row_idx))
  WINDOW w AS (PARTITION BY fold_id ORDER BY row_idx)) GROUP BY fold_id""",
    "cv": """SELECT fold_id, -sum(part * gross) / sum(part) AS cvar95 FROM (SELECT *, CASE WHEN k <= ceil(n * 0.05 - 1e-9) THEN least(greatest(n * 0.05 - k + 1, 0), 1) ELSE 0 END AS part
  FROM (SELECT *, row_number() OVER (PARTITION BY fold_id ORDER BY gross, row_idx) AS k, count(*) OVER (PARTITION BY fold_id) AS n FROM rb)) GROUP BY fold_id""",
    "fm": "SELECT pf.*, max_dd_geo, max_dd_arith, cvar95 FROM pf JOIN dd ON pf.fold_id = dd.fold_id JOIN cv ON pf.fold_id = cv.fold_id",
    "mu": "SELECT fold_id, asset, avg(ret) AS v FROM tr GROUP BY fold_id, asset",
}


def needs(names: list[str]) -> list[str]:
    """The parts in order, up to the last that is asked for, leaving out what nothing uses."""
    import re

    wanted, order = set(names), list(PARTS)
    for p in reversed(order):
        if p in wanted:
            wanted |= {q for q in order if re.search(rf"\b(FROM|JOIN) {q}\b", PARTS[p])}
    return [p for p in order if p in wanted]


def sql(select: str, panel: str = "brand", look: int = 40, step: int = 40, **more: str) -> str:
    """select with the parts it names; more: further parts, in order, that may use them."""
    import re

    text = " ".join([*more.values(), select])
    used = needs([p for p in PARTS if re.search(rf"\b(FROM|JOIN) {p}\b", text)])
    parts = {p: PARTS[p].replace("{panel}", PRICES[panel]).replace("{look}", str(look)).replace("{step}", str(step)) for p in used} | more
    head = ", ".join(f"{k} AS ({v})" for k, v in parts.items())
    return (f"WITH {head} " if head else "") + select


#: Columns of large values: fewer digits after the point are the same in any order of summing.
WIDE = {"price", "cumulative", "open", "high", "low", "close", "volume", "amount", "vwap"}


def digits(name: str) -> int:
    return 5 if name in WIDE else -1 if name.startswith("cov_") or name == "absret_amt20" else 8


def r(*columns: str) -> str:
    """Columns rounded to their digits; "x AS y" or a name."""
    out = []
    for c in columns:
        expression, _, name = c.rpartition(" AS ") if " AS " in c else (c, "", c)
        out.append(f"round({expression}, {digits(name)}) + 0.0 AS {name}")
    return ", ".join(out)
