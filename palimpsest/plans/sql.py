"""DuckDB SQL for the same inputs, items, scores and cells that the DataFrame queries build."""

from __future__ import annotations

from palimpsest.functions import dressings as D
from palimpsest.functions import vocabulary as V
from palimpsest.operators.scoring import BASELINES


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_SUB = D.substitutes()
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def base32(t: str) -> str:
    letters = " || ".join(f"substr('{_UP}234567', CAST(((v >> {35 - 5 * k}) & 31) AS INTEGER) + 1, 1)" for k in range(8))
    hexed = f"hex(encode({t}))"
    body = f"array_to_string(list_transform(list_transform(regexp_extract_all({hexed}, '.{{1,10}}'), lambda x: CAST('0x' || rpad(x, 10, '0') AS BIGINT)), lambda v: {letters}), '')"
    n = f"octet_length(encode({t}))"
    return f"rpad(left({body}, CAST(ceil({n} * 8 / 5.0) AS INTEGER)), CAST(ceil({n} / 5.0) * 8 AS INTEGER), '=')"


DRESS = {
    "base64": lambda t: f"base64(encode({t}))",
    "hex": lambda t: f"lower(hex(encode({t})))",
    "homoglyph": lambda t: f"translate({t}, {text(''.join(_SUB))}, {text(''.join(_SUB.values()))})",
    "zero_width": lambda t: f"array_to_string(string_split({t}, ''), chr(8203))",
    "base32": base32,
    "url_percent": lambda t: f"url_encode({t})",
    "rot13": lambda t: f"translate({t}, '{_UP + _LOW}', '{_UP[13:] + _UP[:13] + _LOW[13:] + _LOW[:13]}')",
}


def dress(t: str, chain: tuple[str, ...]) -> str:
    for link in chain:
        t = DRESS[link](t)
    return t


def kernel(t: str) -> str:
    one = {chr(k): v for k, v in V.CONFUSABLE.items() if len(v) == 1}
    out = f"translate(translate({t}, {text(V.INVISIBLE)}, ''), {text(''.join(one))}, {text(''.join(one.values()))})"
    for k, v in V.CONFUSABLE.items():
        if len(v) > 1:
            out = f"replace({out}, {text(chr(k))}, {text(v)})"
    return out


def norm(t: str) -> str:
    """The normal form of texts that are NFKC-stable and hold no other white space than ASCII's."""
    return f"trim(regexp_replace(lower({t}), '\\s+', ' ', 'g'))"


POOL = "pool AS (SELECT d.lang AS split, d.doc_id AS index, l.toxic AS label, d.source, d.text FROM documents d JOIN labels l USING (doc_id))"

PAYLOADS = f"""{POOL},
every AS (
  SELECT text, 'attack' AS family, CAST(NULL AS VARCHAR) AS benign_class, 1 AS label, source FROM pool WHERE label = 1 AND text <> ''
  UNION ALL SELECT text, 'benign', 'b_code', 0, source FROM pool WHERE label = 0 AND text <> ''
  UNION ALL SELECT DISTINCT text, 'benign', 'b_chat', 0, 'conversations' FROM conversations WHERE role = 'user' AND text <> ''),
payloads AS (
  SELECT text, min(family) AS family, min(benign_class) AS benign_class, min(label) AS label, min(source) AS source, left(sha256(text), 16) AS payload_id
  FROM every GROUP BY text HAVING count(DISTINCT coalesce(benign_class, '')) = 1)"""


def _item(chain: tuple[str, ...]) -> str:
    name = D.chain_name(chain)
    return f"SELECT payload_id || '::{name}' AS item_id, payload_id, source, family, benign_class, label, '{name}' AS chain, {dress('text', chain)} AS text FROM payloads"


ITEMS = PAYLOADS + ",\nitems AS (" + "\nUNION ALL ".join(_item(c) for c in V.CHAINS) + ")"


def candidate(t: str, encoding: str) -> str:
    """Whether a run of an encoding's alphabet is long and uneven enough for the decoder."""
    least, floor = (V.HEX_CHARS, V.HEX_ENTROPY) if encoding == "hex" else (V.BASE64_CHARS, V.BASE64_ENTROPY)
    return f"(length({t}) >= {least} AND list_entropy(string_split({t}, '')) >= {floor})"


#: Where the decoder reports a span, accepted or not.
SPAN = "[A-Za-z0-9+/=]{24}|[0-9A-Fa-f]{16}"


def _peeled(chain: tuple[str, ...], k: int, depth: int) -> tuple[str, str, str]:
    """What the canonicalizer leaves of t{k}, the text after k links, with its depth and ceiling flag.

    This holds for texts that are NFKC-stable and hold no run that decodes; then no encoded form but a whole one does.
    """
    if k == 0 or chain[k - 1] in D.HELD_OUT_DRESSINGS:
        return kernel(f"t{k}"), str(depth), "false"
    if chain[k - 1] not in V.DECODED_LINKS:
        return _peeled(chain, k - 1, depth)
    if depth == V.CEILING:
        return f"t{k}", str(depth), f"ok{k}"
    inner = _peeled(chain, k - 1, depth + 1)
    return tuple(f"CASE WHEN ok{k} THEN {x} ELSE {y} END" for x, y in zip(inner, (f"t{k}", depth, "false"), strict=True))


def _canonical(chain: tuple[str, ...]) -> str:
    steps = ["text AS t0"]
    for k, link in enumerate(chain, 1):
        steps.append(f"{DRESS[link](f't{k - 1}')} AS t{k}")
        if link in V.DECODED_LINKS:
            steps.append(f"{candidate(f't{k}', link)} AS ok{k}")
    seen, depth, hit = _peeled(chain, len(chain), 0)
    name, last = D.chain_name(chain), f"t{len(chain)}"
    glyphs = f"translate({last}, {text(''.join(map(chr, V.CONFUSABLE)))}, '') <> {last}"
    hidden = f"translate({last}, {text(V.INVISIBLE)}, '') <> {last}" + (" OR (ok2 AND length(t0) > 1)" if chain == ("zero_width", "base64") else "")
    return f"""SELECT payload_id || '::{name}' AS item_id, payload_id, source, family, benign_class, label, '{name}' AS chain, {last} AS text, {seen} AS seen, CAST({depth} AS INTEGER) AS depth,
      {hit} AS hit, {hidden} AS invisible, {glyphs} AS confusables, regexp_matches({kernel(last)}, '{SPAN}') AS decode FROM (SELECT *, {', '.join(steps)} FROM payloads)"""


#: Items with their canonical text, depth, ceiling flag and the stages that edit them.
CANONICAL = PAYLOADS + ",\nitems AS (" + "\nUNION ALL ".join(_canonical(c) for c in V.CHAINS) + ")"

_BASE = "baselines(baseline_key, threshold, win) AS (VALUES " + ", ".join(f"('{k}', CAST({t} AS DOUBLE), {w})" for k, t, w in BASELINES) + ")"


def canonical_of(source: str) -> str:
    """CTEs that canonicalize ``source`` (doc_id, t): texts of ASCII or such as are NFKC-stable without lookalikes.

    A pass decodes every run that is one; ``c`` has the text after the ceiling's passes, how many changed it, and
    whether one more would.  A run that joins a decoded text to its host is not told apart from other runs.
    """
    run = {
        "hex": "regexp_full_match(s, '([0-9A-Fa-f]{2})+') AND " + candidate("s", "hex") + " AND TRY(decode(unhex(s))) IS NOT NULL THEN TRY(decode(unhex(s)))",
        "base64": "regexp_full_match(s, '([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?') AND " + candidate("s", "base64") + " AND TRY(decode(from_base64(s))) IS NOT NULL THEN TRY(decode(from_base64(s)))",
    }
    once = f"array_to_string(list_transform(regexp_extract_all(t, '[A-Za-z0-9+/=]+|[^A-Za-z0-9+/=]+'), lambda s: CASE WHEN length(s) < {V.HEX_CHARS} THEN s WHEN {run['hex']} WHEN {run['base64']} ELSE s END), '')"
    steps = [f"p0 AS ({source})"] + [f"p{k + 1} AS MATERIALIZED (SELECT doc_id, t AS was, {once} AS t FROM p{k})" for k in range(V.CEILING + 1)]
    changed = " + ".join(f"CAST(p{k}.t <> p{k}.was AS INTEGER)" for k in range(1, V.CEILING + 1))
    joins = " ".join(f"JOIN p{k} USING (doc_id)" for k in range(2, V.CEILING + 2))
    return ", ".join(steps) + f", c AS (SELECT doc_id, p{V.CEILING}.t AS t, {changed} AS depth, p{V.CEILING + 1}.t <> p{V.CEILING + 1}.was AS hit FROM p1 {joins})"


def digest_score(key: str, t: str) -> str:
    return f"CAST('0x' || left(sha256({key} || chr(31) || {t}), 13) AS BIGINT) / 4503599627370496.0"


SCORES = f"""{CANONICAL},
{_BASE},
conditioned AS (
  SELECT * REPLACE (text AS seen, NULL AS depth, NULL AS hit), 'raw' AS condition FROM items
  UNION ALL SELECT *, 'canonical' FROM items),
scores AS (
  SELECT item_id, family, benign_class, label, baseline_key, condition, {digest_score("baseline_key", "seen")} AS p_injection,
         CAST(1 + length(seen) // win AS INTEGER) AS n_windows, CAST(depth AS INTEGER) AS max_depth_reached, CAST(hit AS BOOLEAN) AS ceiling_hit, chain, payload_id,
         invisible, confusables, decode
  FROM conditioned, baselines)"""

_HELD = ", ".join(f"'{D.chain_name(c)}'" for c in V.HELD_OUT_CHAINS)
KEYED = f"""{SCORES},
kd AS (
  SELECT s.baseline_key, chain, CASE WHEN chain IN ({_HELD}) THEN 'held_out' ELSE 'bound' END AS chain_class, condition = 'canonical' AS canon_on,
         family, benign_class, payload_id, item_id, p_injection, p_injection >= threshold AS detected, n_windows, ceiling_hit, invisible, confusables, decode
  FROM scores s JOIN baselines b USING (baseline_key))"""

AXES = "baseline_key, chain, chain_class, canon_on, family, benign_class"
Z = V.Z95


def wilson(k: str, n: str) -> tuple[str, str]:
    k, n = f"CAST({k} AS DOUBLE)", f"CAST({n} AS DOUBLE)"
    centre = f"(({k} + {Z * Z / 2}) / ({n} + {Z * Z}))"
    half = f"({Z} / ({n} + {Z * Z}) * sqrt({k} * ({n} - {k}) / {n} + {Z * Z / 4}))"
    return (
        f"(CASE WHEN {k} = 0 THEN 0.0 ELSE greatest(0.0, {centre} - {half}) END)",
        f"(CASE WHEN {k} = {n} THEN 1.0 ELSE least(1.0, {centre} + {half}) END)",
    )


def newcombe(source: str, keep: str) -> str:
    """SELECT of ``keep``, n, value, lo, hi from ``source`` with columns a, b, c, d."""
    (l1, u1), (l2, u2) = wilson("n1", "n"), wilson("n2", "n")
    return f"""SELECT {keep}, CAST(n AS BIGINT) AS n, theta AS value,
      theta - sqrt(greatest(x1 * x1 - 2 * phi * x1 * y1 + y1 * y1, 0.0)) AS lo, theta + sqrt(greatest(x2 * x2 - 2 * phi * x2 * y2 + y2 * y2, 0.0)) AS hi
    FROM (SELECT *, CASE WHEN margins = 0 THEN 0.0 ELSE (CASE WHEN cr > 0 THEN greatest(cr - n / 2, 0.0) ELSE cr END) / sqrt(margins) END AS phi FROM
      (SELECT *, (b - c) / n AS theta, n1 / n - {l1} AS x1, {u2} - n2 / n AS y1, {u1} - n1 / n AS x2, n2 / n - {l2} AS y2,
         n1 * (c + d) * n2 * (b + d) AS margins, a * d - b * c AS cr FROM
        (SELECT *, a + b + c + d AS n, a + b AS n1, a + c AS n2 FROM (SELECT * REPLACE (CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(c AS DOUBLE) AS c, CAST(d AS DOUBLE) AS d) FROM ({source}))))) t"""


def table4(source: str, key: str, x: str, y: str) -> str:
    return f"""SELECT {key}, count(*) FILTER ({x} AND {y}) AS a, count(*) FILTER ({x} AND NOT {y}) AS b, count(*) FILTER (NOT {x} AND {y}) AS c,
      count(*) FILTER (NOT {x} AND NOT {y}) AS d FROM ({source}) GROUP BY {key}"""


def cell(source: str, kind: str, **given: str) -> str:
    """The columns of a cell, from ``source``; those not given by name or column are null."""
    types = {"k": "BIGINT", "n": "BIGINT", "value": "DOUBLE", "lo": "DOUBLE", "hi": "DOUBLE", "n_pos": "BIGINT", "n_neg": "BIGINT", "tied": "BIGINT", "pairs": "BIGINT", "canon_on": "BOOLEAN"}
    from palimpsest.operators.cells import COLUMNS

    given = {"kind": f"'{kind}'", "population": "'all'", **given}
    picked = [f"CAST({given.get(c, 'NULL')} AS {types.get(c, 'VARCHAR')}) AS {c}" for c in COLUMNS]
    return f"SELECT {', '.join(picked)} FROM ({source}) s"


_AX = {c: c for c in ("baseline_key", "chain", "chain_class", "canon_on", "family", "benign_class")}


def _rate() -> str:
    lo, hi = wilson("k", "n")
    by = f"SELECT {AXES}, count(*) FILTER (detected) AS k, count(*) AS n FROM kd GROUP BY ALL"
    return cell(by, "rate", **_AX, k="k", n="n", value="k / CAST(n AS DOUBLE)", lo=lo, hi=hi, method="'wilson-score'")


def _census() -> str:
    by = f"""SELECT {AXES}, 'ceiling_hit' AS census, count(*) FILTER (ceiling_hit) AS k, count(*) AS n FROM kd WHERE canon_on GROUP BY ALL
      UNION ALL SELECT {AXES}, 'window_overflow', count(*) FILTER (n_windows > 1), count(*) FROM kd GROUP BY ALL"""
    return cell(by, "count", **_AX, census="census", k="k", n="n")


def _edits() -> str:
    """Documents that each stage edited; the tables' texts are NFKC-stable, so that stage edits none."""
    each = {"invisible": "invisible", "confusables": "confusables", "nfkc": "false", "decode": "decode"}
    by = "\nUNION ALL ".join(f"SELECT {AXES}, 'edits:{k}' AS census, count(*) FILTER ({c}) AS k, count(*) AS n FROM kd WHERE canon_on GROUP BY ALL" for k, c in each.items())
    return cell(by, "count", **_AX, census="census", k="k", n="n")


#: Structural components by comparing every score with every other score's count, cell by cell.
COMPONENTS = """
sides AS (
  SELECT baseline_key, chain, chain_class, canon_on, c.against, item_id, p_injection AS p, family = 'attack' AS positive
  FROM kd JOIN (VALUES ('b_code'), ('b_chat')) c(against) ON family = 'attack' OR benign_class = c.against),
dist AS (
  SELECT baseline_key, chain, chain_class, canon_on, against, p, CAST(count(*) FILTER (positive) AS DOUBLE) AS pos, CAST(count(*) FILTER (NOT positive) AS DOUBLE) AS neg FROM sides GROUP BY ALL),
comp AS (
  SELECT *, (sum(neg) OVER r - neg + neg / 2) / sum(neg) OVER g AS v10, (sum(pos) OVER g - sum(pos) OVER r + pos / 2) / sum(pos) OVER g AS v01,
         sum(pos) OVER g AS n_pos, sum(neg) OVER g AS n_neg
  FROM dist WINDOW g AS (PARTITION BY baseline_key, chain, canon_on, against), r AS (PARTITION BY baseline_key, chain, canon_on, against ORDER BY p)),
item AS (
  SELECT s.*, CASE WHEN positive THEN v10 ELSE v01 END AS v, n_pos, n_neg
  FROM sides s JOIN comp c USING (baseline_key, chain, chain_class, canon_on, against, p)),
aucs AS (
  SELECT baseline_key, chain, chain_class, canon_on, against, avg(v) FILTER (positive) AS auc, max(n_pos) AS n_pos, max(n_neg) AS n_neg,
         var_samp(v) FILTER (positive) / max(n_pos) + var_samp(v) FILTER (NOT positive) / max(n_neg) AS variance
  FROM item GROUP BY ALL),
ties AS (SELECT baseline_key, chain, canon_on, against, sum(pos * neg) AS tied FROM dist GROUP BY ALL)"""


def _auc() -> str:
    by = f"SELECT a.*, tied, {Z} * sqrt(variance) AS half FROM aucs a JOIN ties t USING (baseline_key, chain, canon_on, against) WHERE n_pos > 1 AND n_neg > 1"
    return cell(
        by, "auc", baseline_key="baseline_key", chain="chain", chain_class="chain_class", canon_on="canon_on", benign_class="against", contrast="'attacks_vs_' || against",
        value="auc", lo="greatest(0.0, auc - half)", hi="least(1.0, auc + half)", method="'auc-structural-components'", n_pos="n_pos", n_neg="n_neg", tied="tied", pairs="n_pos * n_neg",
    )


def _auc_delta() -> str:
    by = f"""SELECT baseline_key, chain, chain_class, against, max(n_pos) AS n_pos, max(n_neg) AS n_neg, sum(v / n) AS variance, max(CASE WHEN positive THEN a_on - a_off END) AS value
      FROM (SELECT baseline_key, chain, chain_class, against, positive, count(*) AS n, avg(v_on) AS a_on, avg(v_off) AS a_off, max(n_pos) AS n_pos, max(n_neg) AS n_neg,
              var_samp(v_on - v_off) AS v
            FROM (SELECT x.*, x.v AS v_on, y.v AS v_off FROM item x JOIN item y USING (baseline_key, chain, against, positive, item_id) WHERE x.canon_on AND NOT y.canon_on) GROUP BY ALL)
      WHERE n_pos > 1 AND n_neg > 1 GROUP BY ALL"""
    half = f"{Z} * sqrt(greatest(variance, 0.0))"
    return cell(by, "delta", baseline_key="baseline_key", chain="chain", chain_class="chain_class", benign_class="against", contrast="'canon_on_vs_off'", value="value", lo=f"value - {half}", hi=f"value + {half}", method="'delta-auc-structural-components'", n_pos="n_pos", n_neg="n_neg")


_ITEM = "baseline_key, chain, chain_class, family, benign_class"


def _canon_delta(single: bool) -> str:
    two = f"SELECT x.*, x.detected AS d_on, y.detected AS d_off FROM kd x JOIN kd y USING (baseline_key, item_id) WHERE x.canon_on AND NOT y.canon_on" + (" AND x.n_windows = 1 AND y.n_windows = 1" if single else "")
    by = newcombe(table4(two, _ITEM, "d_on", "d_off"), _ITEM)
    axes = {c: c for c in ("baseline_key", "chain", "chain_class", "family", "benign_class")}
    return cell(by, "delta", **axes, contrast="'canon_on_vs_off'", population="'single_window'" if single else "'all'", n="n", value="value", lo="lo", hi="hi", method="'newcombe-paired-score'")


def _chain_delta() -> str:
    key = "baseline_key, canon_on, family, benign_class, chain, chain_class"
    two = "SELECT x.*, y.detected AS d_clean FROM kd x JOIN kd y ON x.baseline_key = y.baseline_key AND x.canon_on = y.canon_on AND x.family = y.family AND x.benign_class IS NOT DISTINCT FROM y.benign_class AND x.payload_id = y.payload_id WHERE x.chain <> 'clean' AND y.chain = 'clean'"
    by = newcombe(table4(two, key, "d_clean", "detected"), key)
    axes = {c: c for c in ("baseline_key", "canon_on", "family", "benign_class")}
    return cell(by, "delta", **axes, chain_class="CASE WHEN chain_class = 'bound' THEN chain_class END", contrast="'clean_vs_' || chain", n="n", value="value", lo="lo", hi="hi", method="'newcombe-paired-score'")


PARTS = {"rate": _rate(), "census": _census(), "auc": _auc(), "canon": _canon_delta(False), "chain": _chain_delta(), "auc_delta": _auc_delta(), "single": _canon_delta(True)}
CELLS = f"{KEYED},{COMPONENTS},\ncells AS (" + "\nUNION ALL ".join(PARTS.values()) + ")"

PARTS["edits"] = _edits()  # not of CELLS: it needs traces


def cells_of(part: str) -> str:
    """SQL of one producer's cells, rounded."""
    with_ = f"{KEYED},{COMPONENTS}" if "auc" in part else KEYED
    return f"WITH {with_} {rounded(PARTS[part])}"


def rounded(select: str) -> str:
    return f"SELECT * REPLACE (round(value, 9) + 0.0 AS value, round(lo, 9) + 0.0 AS lo, round(hi, 9) + 0.0 AS hi) FROM ({select})"


#: CASE of section names, as operators.report.section has them.
SECTION = """CASE WHEN kind = 'rate' AND family = 'attack' THEN 'recall' WHEN kind = 'rate' AND family = 'benign' THEN 'false positives'
  WHEN method = 'newcombe-paired-score' AND contrast = 'canon_on_vs_off' AND population = 'all' THEN 'canonical against raw'
  WHEN starts_with(contrast, 'clean_vs_') THEN 'clean against dressed' WHEN method = 'delta-auc-structural-components' THEN 'area difference' WHEN kind = 'auc' THEN 'area'
  WHEN method = 'newcombe-paired-score' AND population = 'single_window' THEN 'single window' WHEN kind = 'count' THEN 'census' END"""

FINDINGS = f"""{CELLS},
canon AS (SELECT * FROM cells WHERE contrast = 'canon_on_vs_off'),
fnd AS (
  SELECT 'saturation' AS finding, baseline_key, chain, chain_class, benign_class, canon_on, family, CAST(tied AS DOUBLE) AS x, CAST(pairs AS DOUBLE) AS y, tied / CAST(pairs AS DOUBLE) AS lim
  FROM cells WHERE kind = 'auc' AND tied / CAST(pairs AS DOUBLE) > {V.TIE_SHARE}
  UNION ALL SELECT 'resolution', baseline_key, chain, chain_class, benign_class, canon_on, family, n_neg, n_pos, 1 / CAST(n_neg AS DOUBLE) FROM cells WHERE kind = 'auc'
  UNION ALL SELECT 'rate_pinned', x.baseline_key, x.chain, x.chain_class, x.benign_class, NULL, x.family, y.k, x.k, CASE WHEN x.k = 0 THEN 0.0 ELSE 1.0 END
  FROM cells x JOIN cells y ON x.kind = 'rate' AND y.kind = 'rate' AND x.baseline_key = y.baseline_key AND x.chain = y.chain AND x.family = y.family AND x.benign_class IS NOT DISTINCT FROM y.benign_class
    AND x.canon_on AND NOT y.canon_on WHERE (x.k = 0 AND y.k = 0) OR (x.k = x.n AND y.k = y.n)
  UNION ALL SELECT 'sign_disagreement', x.baseline_key, x.chain, x.chain_class, x.benign_class, x.canon_on, x.family, x.value, y.value, 0
  FROM canon x JOIN canon y ON x.baseline_key = y.baseline_key AND x.chain = y.chain AND x.method = 'delta-auc-structural-components' AND y.method = 'newcombe-paired-score'
    AND y.family = 'attack' AND y.population = 'all' WHERE sign(x.value) * sign(y.value) < 0
  UNION ALL SELECT 'bound_chain_definitional', baseline_key, chain, chain_class, benign_class, canon_on, family, value, NULL, NULL
  FROM canon WHERE method = 'delta-auc-structural-components' AND chain_class = 'bound'
  UNION ALL SELECT 'windows_matched_divergence', x.baseline_key, x.chain, x.chain_class, x.benign_class, NULL, x.family, x.value, y.value, (y.hi - y.lo) / 2
  FROM canon x JOIN canon y ON x.baseline_key = y.baseline_key AND x.chain = y.chain AND x.family = y.family AND x.benign_class IS NOT DISTINCT FROM y.benign_class
    AND x.method = 'newcombe-paired-score' AND y.method = x.method AND x.population = 'all' AND y.population = 'single_window' WHERE abs(x.value - y.value) > (y.hi - y.lo) / 2)"""
