"""The derived views as SQL, used as common table expressions of the check queries."""

from __future__ import annotations

from formulake import vocab as V
from formulake.plans import views as P

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(values: list[str]) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def inlist(values: list[str]) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def pick(values: list[str], index: str) -> str:
    return f"{words(values)}[cast({index} as bigint) + 1]"


def r6(e: str) -> str:
    v = f"(cast({e} as double) + 3e-10)"
    return f"(CASE WHEN abs({v}) < 5e-7 THEN cast(0.0 as double) ELSE round({v}, 6) END)"


def let(var: str, value: str, body: str) -> str:
    """Evaluate a value once under a name."""
    return f"(list_transform([{value}], lambda {var}: {body})[1])"


def num(e: str) -> str:
    return f"(CASE WHEN regexp_matches(trim({e}), '{NUMBER}') THEN try_cast(trim({e}) AS DOUBLE) END)"


def as_percent(e: str, keep_zero: bool = False) -> str:
    s = f"(CASE WHEN {e} > 0 AND {e} <= 1 THEN {e} * 100 ELSE {e} END)"
    op = ">=" if keep_zero else ">"
    return f"(CASE WHEN {s} {op} 0 AND {s} <= 100 THEN {s} END)"


def bare_outcome(e: str) -> str:
    return (
        f"regexp_replace(regexp_replace(trim({e}), {lit(V.OUTCOME_NOTE)}, '', 'g'), "
        f"{lit(V.OUTCOME_ERROR)}, '', 'g')"
    )


def clean_outcome(e: str) -> str:
    lo = f"try_cast(nullif(regexp_extract(zb, {lit(V.OUTCOME_RANGE)}, 1), '') AS DOUBLE)"
    hi = f"try_cast(nullif(regexp_extract(zb, {lit(V.OUTCOME_RANGE)}, 2), '') AS DOUBLE)"
    first = "try_cast(nullif(regexp_extract(zb, '([\\d.]+)', 1), '') AS DOUBLE)"
    middle = let("zl", lo, let("zh", hi, f"CASE WHEN zh > zl THEN (zl + zh) / 2 ELSE {first} END"))
    value = let("zb", bare_outcome(e), middle)
    return (
        f"(CASE WHEN {e} IS NOT NULL AND lower(trim({e})) NOT IN {inlist(V.MISSING_MARKS)} "
        f"THEN {let('zv', value, as_percent('zv'))} END)"
    )


def naive_outcome(e: str) -> str:
    return f"try_cast(nullif(regexp_replace({e}, '[^0-9.]', '', 'g'), '') AS DOUBLE)"


def numbers(e: str) -> str:
    return (
        f"list_transform(string_split(regexp_replace(trim({e}), '[/\\-,;|]', ':', 'g'), ':'), "
        f"lambda p: {num('p')})"
    )


def total(arr: str) -> str:
    return f"coalesce(list_sum(list_transform({arr}, lambda v: coalesce(v, 0.0))), 0.0)"


def colon_parts(e: str) -> str:
    return (
        f"list_filter(list_transform(string_split(coalesce({e}, ''), ':'), lambda p: trim(p)), "
        f"lambda p: p <> '')"
    )


def plain(e: str) -> str:
    return (
        f"regexp_replace(regexp_replace(cast(cast({e} as decimal(18,4)) as varchar), '0+$', ''), "
        f"'\\.$', '')"
    )


def ratio_text(arr: str) -> str:
    return f"array_to_string(list_transform({arr}, lambda v: {plain('v')}), ':')"


def ratio_key(e: str) -> str:
    body = (f"CASE WHEN len(list_filter(zn, lambda v: v IS NULL)) = 0 THEN {ratio_text('list_sort(zn)')} "
            f"ELSE lower(trim(coalesce({e}, ''))) END")
    return let("zn", numbers(e), body)


def content_key(study: str, name: str, ratio: str, outcome: str) -> str:
    return (
        f"concat_ws('|', lower(trim(coalesce({study}, ''))), lower(trim(coalesce({name}, ''))), "
        f"{ratio_key(ratio)}, coalesce(cast(cast(round({outcome} * 10) as bigint) as varchar), ''))"
    )


def components(src: str) -> str:
    """Columns ionizable, helper, chol, peg from a list column named nums."""
    return f"""
      SELECT *, CASE WHEN n_valid = 4 THEN [nums[1], nums[2], nums[3], nums[4]]
                     WHEN n_valid = 3 THEN [nums[1], 0.0, nums[2], nums[3]] END AS comp
      FROM (SELECT *, len(list_filter(nums, lambda v: v IS NOT NULL)) AS n_valid FROM {src})"""


def share(i: int) -> str:
    t = total("comp")
    return f"(CASE WHEN {t} > 0 THEN comp[{i}] / {t} * 100 END)"


def peg_share(e: str) -> str:
    t = total("list_slice(zn, 1, greatest(zk, 1))")
    value = let("zt", t, "CASE WHEN zk IN (3, 4) AND zt <> 0 THEN zn[zk] / zt * 100 END")
    return let("zn", numbers(e), let("zk", "len(list_filter(zn, lambda v: v IS NOT NULL))", value))


TENTHS = "concat({v} // 10, '.', {v} % 10)"
SHOWN = TENTHS.format(v="y10")

FORM = f"""
base AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber,
                   cast(l_quantity as bigint), cast(l_shipdate as date)) AS row_id,
         concat('10.1000/o', l_orderkey) AS study_small,
         concat('10.1000/s', l_suppkey) AS study_big,
         l_orderkey AS order_no, cast(l_linenumber as bigint) AS line_no, l_partkey AS part_no,
         cast(l_quantity as bigint) AS qty,
         cast(CASE WHEN l_orderkey % 211 = 0 THEN 0 ELSE least(1000, 550 + 30 * (l_suppkey % 7)
              + 20 * cast(round(l_discount * 100) as bigint)
              - 25 * cast(round(l_tax * 100) as bigint)
              + 2 * cast(l_quantity as bigint)) END as bigint) AS y10,
         5 + 10 * cast(round(l_tax * 100) as bigint) AS c4t,
         cast(1 + cast(l_quantity as bigint) % 60 as double) AS np,
         cast(3 + l_linenumber as double) AS ph,
         cast(20 + l_partkey % 600 as double) AS size,
         cast(l_suppkey % 120 as double) / 100 AS pdi,
         cast(l_orderkey % 150 - 75 as double) AS zeta,
         {pick(P.NAMES + [''], 'least(10, l_partkey % 14)')} AS name0,
         {pick(P.PEGS, 'l_partkey % 4')} AS peg_name,
         {pick(P.CARGOS, '(l_partkey + l_linenumber) % 8')} AS cargo_raw
  FROM lineitem),
form AS MATERIALIZED (
  SELECT base.* EXCLUDE (name0, c4t),
         CASE WHEN part_no % 97 = 0 THEN 'n.r.' ELSE
           replace(concat_ws(':', qty + 10, CASE WHEN line_no <> 7 THEN 3 * line_no END,
             20 + part_no % 30, {TENTHS.format(v='c4t')},
             CASE WHEN line_no = 6 THEN CASE WHEN part_no % 2 = 0 THEN '2' ELSE '60' END END),
             ':', {pick([':', '/', ';', '|'], 'order_no % 4')}) END AS ratio_raw,
         y10 / 10.0::double AS y,
         CASE order_no % 8
           WHEN 0 THEN {SHOWN}
           WHEN 1 THEN concat({SHOWN}, ' ± 2.5')
           WHEN 2 THEN concat(y10 // 10, '-', y10 // 10 + 5)
           WHEN 3 THEN concat({SHOWN}, ' (n=3)')
           WHEN 4 THEN concat('0.', lpad(cast(least(99, y10 // 10) as varchar), 2, '0'))
           WHEN 5 THEN concat('>', {SHOWN})
           WHEN 6 THEN CASE WHEN line_no = 1 THEN 'n.d.' ELSE {SHOWN} END
           ELSE CASE WHEN line_no = 2 THEN cast(y10 // 10 + 40 as varchar) ELSE {SHOWN} END
         END AS outcome_raw,
         CASE WHEN name0 <> '' THEN name0 WHEN order_no % 2 = 0 THEN upper(p_name)
              ELSE replace(p_name, ' ', '-') END AS name_raw,
         p_name AS part_name
  FROM base LEFT JOIN part ON part_no = p_partkey)"""

COLON = """
colon AS (SELECT *, translate(ratio_raw, '/;|', ':::') AS ratio FROM form)"""

BATCH_COLS = "study_big, ratio, outcome_raw, name_raw, peg_name, cargo_raw, part_no, line_no"
BATCH = f"""
batch AS (
  SELECT row_id, {BATCH_COLS} FROM colon
  UNION ALL
  SELECT concat(row_id, '-r'), study_big,
         concat_ws(':', p[2], p[1], array_to_string(list_slice(p, 3, len(p)), ':')),
         outcome_raw, name_raw, peg_name, cargo_raw, part_no, line_no
  FROM (SELECT *, string_split(ratio, ':') AS p FROM colon WHERE line_no = 1)
  WHERE len(p) >= 3)"""

STORE = """
store AS (SELECT * FROM colon WHERE order_no % 10 <> 0 OR part_no % 5 = 0)"""

OBS = f"""
obs_raw AS MATERIALIZED (
  SELECT * REPLACE ({clean_outcome('outcome_raw')} AS y), {peg_share('ratio_raw')} AS x FROM form),
obs AS MATERIALIZED (
  SELECT * REPLACE ({r6('x')} AS x, {r6('y')} AS y) FROM obs_raw WHERE x IS NOT NULL AND y IS NOT NULL)"""

FEATURED = f"""
parsed_raw AS MATERIALIZED (SELECT * REPLACE ({clean_outcome('outcome_raw')} AS y),
             {numbers('ratio_raw')} AS nums FROM form),
parsed AS (SELECT * REPLACE ({r6('y')} AS y) FROM parsed_raw WHERE y IS NOT NULL),
comps AS ({components('parsed')}),
featured AS MATERIALIZED (
  SELECT *, ionizable / nullif(helper, 0) AS ion_to_helper, ionizable + chol AS ion_plus_chol,
         ln(1 + peg) AS log_peg
  FROM (SELECT * EXCLUDE (comp, nums), {share(1)} AS ionizable, {share(2)} AS helper,
               {share(3)} AS chol, {share(4)} AS peg FROM comps)
  WHERE peg IS NOT NULL)"""


def hash_share(e: str, k: int) -> str:
    return f"(cast(concat('0x', substr(md5({e}), 1, 6)) as bigint) % {k})"


def folds(src: str = "rows0", k: int = 5) -> str:
    """CTE folded over a relation with columns study, ..."""
    return f"""
folded AS (SELECT {src}.*, cast({hash_share('study', k)} as bigint) AS fold FROM {src})"""


def oof(study: str = "study_big") -> str:
    return f"""
rows0 AS (SELECT row_id, {study} AS study, x, y FROM obs),
{folds('rows0')},
lines AS (
  SELECT f.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a
  FROM (SELECT DISTINCT fold FROM folded) f JOIN folded r ON r.fold <> f.fold GROUP BY f.fold),
oof AS MATERIALIZED (
  SELECT row_id, study, x, y, fold, {r6('a + b * x')} AS pred FROM folded JOIN lines USING (fold))"""


def _eff(n: str, lead: str) -> str:
    return f"concat('{lead}', {n}, '%.')"


def _mixed(r: str) -> str:
    return (
        "concat(chr(10), 'The ', name, ', DSPC, cholesterol and DMG-PEG2000 were mixed at a molar "
        f"ratio of ', {r}, ' and formed particles.')"
    )


_EFF = _eff("n", " The encapsulation efficiency was ")
_LATER = _eff("n - 10", " After storage the encapsulation efficiency was ")
_ABOUT = _eff("n", " The encapsulation efficiency was approximately ")

ARTICLES = f"""
art0 AS (
  SELECT doc_id, doc_id AS k, text, 60 + doc_id % 39 AS n,
         {pick(P.ARTICLE_NAMES, 'doc_id % 6')} AS name,
         concat(40 + doc_id % 15, ':', 5 + doc_id % 10, ':', 30 + doc_id % 9, '.5:1.5') AS ratio,
         concat(41 + doc_id % 15, ':', 5 + doc_id % 10, ':', 30 + doc_id % 9, '.5:1.5') AS ratio2,
         concat('Delivery study ', doc_id, ' of ', {pick(P.ARTICLE_CARGOS, 'doc_id % 5')},
                ' particles in vivo') AS title
  FROM documents),
articles AS MATERIALIZED (
  SELECT doc_id, title, concat(title, chr(10),
    CASE WHEN k % 7 = 0 THEN '' ELSE concat('doi: 10.5555/st.', k, ' ref PMC', 1000000 + k) END,
    chr(10), text,
    CASE k % 8
      WHEN 0 THEN concat({_mixed('ratio')}, {_EFF}, process)
      WHEN 1 THEN concat({_mixed('ratio')}, {_EFF}, {_LATER}, process)
      WHEN 2 THEN concat({_mixed('ratio')}, {_mixed('ratio2')}, {_EFF}, {_LATER})
      WHEN 3 THEN concat({_mixed('ratio')}, repeat('{P.FILLER}', 150), {_EFF}, {_LATER})
      WHEN 4 THEN concat(chr(10), {_EFF})
      WHEN 5 THEN concat({_mixed('ratio')}, ' EE (%) = (m2 - m1) / m2 × 100%.',
                         ' The encapsulation efficiency typically exceeds 90%.')
      WHEN 6 THEN ''
      ELSE concat({_mixed("concat(ratio, ':2')")}, {_ABOUT}) END,
    CASE WHEN k % 9 = 0 THEN concat(chr(10), 'Figure 1. Particles at ', ratio, ' with EE of ', n, '%.')
         ELSE '' END) AS body
  FROM (SELECT *, concat(' At pH ', 4 + k % 3, '.0 and N/P ', 3 + k % 6, ', particle size ',
          80 + k % 60, ' nm, PDI 0.', lpad(cast(k % 40 as varchar), 2, '0'), ', zeta -', k % 20,
          ' mV.') AS process FROM art0))"""

CLAIMS = f"""
claims0 AS (
  SELECT doc_id AS k, v, 40 + doc_id % 15 AS a, 5 + doc_id % 10 AS b,
         concat(30 + doc_id % 9, '.5') AS c
  FROM (SELECT doc_id FROM documents WHERE doc_id % 8 IN (0, 1, 7)
        UNION ALL SELECT 1000000002 + doc_id FROM documents WHERE doc_id % 40 = 0), range(10) t(v)),
claims AS (
  SELECT concat(k, '-', v) AS claim_id, k AS doc_id, v AS variant,
    CASE WHEN v = 3 THEN 'DSPC' WHEN v = 5 THEN 'FTT5' WHEN k % 11 = 0 THEN 'cationic lipid'
         ELSE {pick(P.ARTICLE_NAMES, 'k % 6')} END AS name,
    CASE WHEN v = 2 THEN concat_ws(':', '1.5', c, b, a) WHEN v = 4 THEN concat_ws(':', a, b, c, '2.75')
         WHEN v = 9 THEN concat_ws(':', a, b, c, '1.5', '60')
         ELSE concat_ws(':', a, b, c, '1.5') END AS ratio,
    cast(CASE WHEN v = 8 THEN NULL WHEN v = 6 THEN 120.0 WHEN v = 1 THEN (60 + k % 39) + 0.7
         ELSE 60 + k % 39 END as double) AS ee,
    cast(CASE WHEN v = 7 THEN 12.0 ELSE 4 + k % 3 END as double) AS ph,
    cast(3 + k % 6 as double) AS np, cast(80 + k % 60 as double) AS size,
    cast(0.15 as double) AS pdi, cast(-(k % 20) as double) AS zeta,
    {pick(P.PEGS, 'k % 4')} AS peg_name, 'DSPC' AS helper_name,
    CASE WHEN k % 3 = 0 THEN '' WHEN k % 3 = 1 THEN 'unclear' ELSE 'mRNA' END AS cargo_claim,
    concat(CASE WHEN k % 8 = 7 THEN 'approximately ' ELSE 'measured ' END, 60 + k % 39,
           '% encapsulation') AS evidence
  FROM claims0)"""

CELLS = """
cells0 AS (
  SELECT doc_id AS k, r FROM documents, range(4) t(r) WHERE doc_id % 5 = 0),
cells1 AS (
  SELECT k, r, CASE WHEN r = 0
      THEN ['Sample', 'Lipid molar ratio', 'EE (%)', 'Size (nm)', 'PDI', 'Zeta (mV)']
      ELSE [concat('F', r),
            CASE WHEN k % 25 = 0 AND r = 3 THEN 'n.r.' ELSE
              concat_ws(':', 40 + (k + r) % 15, 5 + k % 10, concat(30 + r, '.5'), '1.5') END,
            CASE WHEN (k + r) % 4 = 0 THEN '-' ELSE concat(60 + (k + 7 * r) % 40, ' ± 2') END,
            cast(70 + (k + r) % 50 as varchar), concat('0.', 10 + (k + r) % 30),
            concat('-', (k + r) % 30)] END AS line
  FROM cells0),
cells AS (
  SELECT k AS doc_id, cast(1 as bigint) AS tbl_no, r AS row_no, unnest(range(len(l))) AS col_no,
         unnest(l) AS cell
  FROM (SELECT k, r, CASE WHEN k % 10 = 0 THEN list_slice(line, 1, 5) ELSE line END AS l FROM cells1))"""

LOOKUP = """
lookup AS (
  SELECT p_name AS name, concat('C', repeat('C', k % 5), 'N(', repeat('C', k % 3 + 1), ')CC(=O)O',
         repeat('n', k % 2)) AS smiles
  FROM (SELECT p_name, cast(min(p_partkey) as integer) AS k FROM part GROUP BY p_name) WHERE k % 7 <> 0)"""

VIEWS = {
    "form": (FORM, []), "colon": (COLON, ["form"]), "batch": (BATCH, ["colon"]),
    "store": (STORE, ["colon"]), "obs": (OBS, ["form"]), "featured": (FEATURED, ["form"]),
    "articles": (ARTICLES, []), "claims": (CLAIMS, []), "cells": (CELLS, []),
    "lookup": (LOOKUP, []), "oof": (oof(), ["obs"]), "oof_small": (oof("study_small"), ["obs"]),
}


def sql(needs: str, body: str, *extra: str) -> str:
    """A complete statement: the named views, further CTEs, and the query itself."""
    order: list[str] = []

    def add(name):
        for parent in VIEWS[name][1]:
            add(parent)
        if name not in order:
            order.append(name)

    for name in needs.split():
        add(name)
    parts = [VIEWS[n][0].strip() for n in order] + [e.strip() for e in extra]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body.strip()
