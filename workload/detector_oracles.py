"""Oracle statements for the detectors, written from their definitions, per table."""

from __future__ import annotations

from workload.views import COLUMNS

CORE = (
    "issue_type, detector_id, column_names, affected_count, raw_score, confidence, fpr, severity"
)


def cols(table: str, kind: str | None = None) -> list[str]:
    return [c for c, k in COLUMNS[table].items() if kind is None or k == kind]


def hinted(names, hints, skip=()):
    return [n for n in names if any(h in n for h in hints) and not any(s in n for s in skip)]


def row(detector, columns, n, raw, conf, fpr, sev, issue=None, more="") -> str:
    """The select list of one candidate."""
    return (
        f"'{issue or detector}' AS issue_type, '{detector}' AS detector_id, {columns} AS column_names, "
        f"CAST({n} AS BIGINT) AS affected_count, round(CAST({raw} AS DOUBLE), 6) AS raw_score, "
        f"CAST({conf} AS DOUBLE) AS confidence, CAST({fpr} AS DOUBLE) AS fpr, {sev} AS severity{more}"
    )


def counted(table, detector, names, pred, conf, sev="'low'", fpr=0.1, keep="n > 0", raw="n", issue=None):
    parts = [
        f"SELECT {row(detector, repr(c), 'n', raw, conf, fpr, sev, issue)} FROM (SELECT count(*) AS total, "
        f"count(*) FILTER (WHERE {pred.format(c=c)}) AS n FROM {table}) WHERE {keep}"
        for c in names
    ]
    return " UNION ALL ".join(parts)


RATIO = "CAST(n AS DOUBLE) / total"
MISSING = "('na','n/a','null','none','-','?','unknown','missing','todo','tbd','n.a.')"
PLACEHOLDER = "('test','xxx','foo','abc','12345','dummy','example')"
OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{{2}}|[1-9]?[0-9])"
ISO = r"^\d{{4}}-\d{{2}}-\d{{2}}$"


def d01(t):
    sev = f"CASE WHEN {RATIO} > 0.3 THEN 'high' WHEN {RATIO} > 0.1 THEN 'medium' ELSE 'low' END"
    return counted(
        t, "excessive_null_rate", cols(t), "{c} IS NULL", 0.95, sev, keep=f"{RATIO} > 0.05", raw=RATIO
    )


def d02(t):
    return counted(
        t,
        "suspicious_missing_token",
        cols(t, "str"),
        "lower(trim({c})) IN " + MISSING,
        0.9,
        keep=f"{RATIO} > 0.005",
    )


def d03(t, evidence=False):
    names = cols(t)
    times = [(c, f"CAST({c} AS DATE)") for c in cols(t, "time")]
    times += [
        (c, f"CAST(TRY_CAST(trim({c}) AS TIMESTAMP) AS DATE)")
        for c in hinted(cols(t, "str"), ("_at", "_time", "date", "time"))
    ]
    cells = " UNION ALL ".join(
        f"SELECT '{tc}' AS tc, '{x}' AS tgt, {i} AS ord, {expr} AS d, count(*) AS n, "
        f"count(*) FILTER (WHERE {x} IS NULL) AS nulls FROM {t} GROUP BY {expr}"
        for tc, expr in times
        for i, x in enumerate(names)
    )
    more = (
        ", time_column, bucket, granularity, CAST(n AS BIGINT) AS bucket_size" if evidence else ""
    )
    return (
        f"SELECT {row('sudden_missingness', 'tgt', 'nulls', 'nulls / CAST(n AS DOUBLE)', 0.9, 0.15, repr('medium'), more=more)} FROM ("
        f"WITH cells AS ({cells}), overall AS (SELECT tgt, ord, sum(nulls) / CAST(sum(n) AS DOUBLE) AS rate FROM cells "
        f"WHERE tc = '{times[0][0]}' GROUP BY tgt, ord), chosen AS (SELECT * FROM overall "
        f"WHERE rate >= 0.01), spans AS (SELECT tc, count(DISTINCT d) AS days, count(DISTINCT strftime(d, '%Y-%m')) AS months "
        f"FROM cells WHERE d IS NOT NULL GROUP BY tc), sized AS (SELECT c.*, ch.rate, CASE WHEN days >= 5 THEN 'day' "
        f"WHEN months >= 5 THEN 'month' ELSE 'year' END AS granularity FROM cells c JOIN spans s ON c.tc = s.tc "
        f"JOIN chosen ch ON ch.tgt = c.tgt WHERE d IS NOT NULL) "
        f"SELECT tc AS time_column, tgt, granularity, CASE granularity WHEN 'day' THEN strftime(d, '%Y-%m-%d') "
        f"WHEN 'month' THEN strftime(d, '%Y-%m') ELSE strftime(d, '%Y') END AS bucket, sum(n) AS n, sum(nulls) AS nulls, "
        f"max(rate) AS rate FROM sized GROUP BY ALL HAVING sum(n) >= 10 AND sum(nulls) / CAST(sum(n) AS DOUBLE) >= "
        f"greatest(0.2, max(rate) + 0.2))"
    )


def d04(t, evidence=False):
    groups = cols(t, "str")
    names = cols(t)
    cells = " UNION ALL ".join(
        f"SELECT '{g}' AS gc, {gi} AS go, {g} AS gv, '{x}' AS tgt, {xi} AS xo, count(*) AS n, "
        f"count(*) FILTER (WHERE {x} IS NULL) AS nulls FROM {t} GROUP BY {g}"
        for gi, g in enumerate(groups)
        for xi, x in enumerate(names)
    )
    more = ", gc AS group_column, gv AS group_value, CAST(n AS BIGINT) AS group_size" if evidence else ""
    return (
        f"SELECT {row('group_missingness', 'tgt', 'nulls', 'nulls / CAST(n AS DOUBLE)', 0.85, 0.15, repr('medium'), more=more)} FROM ("
        f"WITH cells AS ({cells}), usable AS (SELECT gc FROM cells WHERE xo = 0 GROUP BY gc "
        f"HAVING count(gv) BETWEEN 2 AND 50 AND count(*) = count(gv)), "
        f"rates AS (SELECT gc, tgt, sum(nulls) / CAST(sum(n) AS DOUBLE) AS rate FROM cells GROUP BY gc, tgt), "
        f"hits AS (SELECT c.*, r.rate FROM cells c JOIN usable u ON u.gc = c.gc JOIN rates r ON r.gc = c.gc AND r.tgt = c.tgt "
        f"WHERE r.rate > 0 AND n >= 10 AND nulls / CAST(n AS DOUBLE) >= greatest(0.2, rate + 0.2)) SELECT * FROM hits)"
    )


def _pairs(t):
    names = cols(t)
    return " UNION ALL ".join(
        f"SELECT CASE WHEN nb > na THEN '{b}' ELSE '{a}' END AS a, CASE WHEN nb > na THEN '{a}' ELSE '{b}' END AS b, "
        f"greatest(na, nb) AS a_null, least(na, nb) AS b_null, both_null, total FROM (SELECT count(*) AS total, "
        f"count(*) FILTER (WHERE {a} IS NULL) AS na, count(*) FILTER (WHERE {b} IS NULL) AS nb, "
        f"count(*) FILTER (WHERE {a} IS NULL AND {b} IS NULL) AS both_null FROM {t}) "
        f"WHERE least(na, nb) >= 0.02 * total AND total > 0"
        for i, a in enumerate(names)
        for b in names[i + 1 :]
    )


def d05(t):
    return (
        f"SELECT {row('conditional_missingness', 'a || chr(44) || b', 'both_null', 'both_null / CAST(a_null AS DOUBLE)', 0.85, 0.15, repr('medium'))} "
        f"FROM ({_pairs(t)}) WHERE a_null >= 10 AND both_null / CAST(a_null AS DOUBLE) >= 0.8"
    )


def d06(t):
    return (
        f"SELECT {row('correlated_missingness', 'a || chr(44) || b', 'both_null', 'both_null / CAST(b_null AS DOUBLE)', 0.85, 0.15, repr('low'))} "
        f"FROM ({_pairs(t)}) WHERE both_null >= 5 AND both_null / CAST(b_null AS DOUBLE) >= 0.5"
    )


def d07(t, evidence=False):
    more = ", CAST(all_dups AS BIGINT) AS total_duplicates" if evidence else ""
    return " UNION ALL ".join(
        f"SELECT {row('uniqueness_violation', repr(c), 'dup', 'dup', 0.98, 0.1, repr('medium'), more=more)} FROM (SELECT "
        f"sum(n - 1) AS dup, sum(n - 1) AS all_dups FROM "
        f"(SELECT {c}, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1)) WHERE dup IS NOT NULL"
        for c in cols(t)
    )


def d08(t):
    return " UNION ALL ".join(
        f"SELECT {row('fuzzy_duplicate', repr(c), 'dup', 'dup', 0.9, 0.15, repr('medium'))} FROM (SELECT sum(n - 1) AS dup FROM ("
        f"SELECT norm, count(*) AS n FROM (SELECT lower(regexp_replace({c}, '[^0-9A-Za-z一-鿿]', '', 'g')) AS norm, {c} AS v "
        f"FROM {t} WHERE {c} IS NOT NULL) WHERE length(norm) >= 2 GROUP BY norm HAVING count(*) >= 2 AND count(DISTINCT v) >= 2)) WHERE dup IS NOT NULL"
        for c in cols(t, "str")
    )


def d09(t):
    return counted(
        t, "suspicious_placeholder", cols(t, "str"), "lower(trim({c})) IN " + PLACEHOLDER, 0.95
    )


def d10(t):
    return " UNION ALL ".join(
        f"SELECT {row('rare_category', repr(c), 'hits', 'shown', 0.85, 0.1, repr('low'))} FROM (SELECT sum(n) AS hits, count(*) AS shown "
        f"FROM (SELECT {c}, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) < 5 AND "
        f"count(*) * 1000 < (SELECT count(*) FROM {t}))), (SELECT count(DISTINCT {c}) AS d, count({c}) AS nn FROM {t}) "
        f"WHERE hits IS NOT NULL AND d BETWEEN 2 AND 1000 AND d / CAST(nn AS DOUBLE) <= 0.9"
        for c in cols(t)
    )


def d11(t):
    names = [c for c in cols(t) if not hinted([c], ("_id", "id_", " id", "key", "code", "uuid", "hash"))]
    return " UNION ALL ".join(
        f"SELECT {row('category_explosion', repr(c), 'd', 'd / CAST(nn AS DOUBLE)', 0.8, 0.1, repr('low'))} FROM (SELECT count(DISTINCT {c}) AS d, "
        f"count({c}) AS nn FROM {t}) WHERE nn > 0 AND d / CAST(nn AS DOUBLE) > 0.9"
        for c in names
    )


def d12(t):
    return " UNION ALL ".join(
        f"SELECT {row('inconsistent_case', repr(c), 'hits', 'groups', 0.9, 0.1, repr('low'))} FROM (SELECT sum(n) AS hits, count(*) AS groups FROM ("
        f"SELECT lower(trim({c})) AS k, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY lower(trim({c})) "
        f"HAVING count(DISTINCT trim({c})) >= 2)) WHERE hits IS NOT NULL"
        for c in cols(t, "str")
    )


def d13(t):
    return counted(t, "leading_or_trailing_whitespace", cols(t, "str"), "{c} <> trim({c})", 0.98)


def d14(t):
    return counted(
        t, "repeated_whitespace", cols(t, "str"), r"regexp_matches({c}, '\s{{2,}}')", 0.95
    )


def d15(t):
    pred = r"regexp_matches({c}, '[\x00-\x08\x0b\x0c\x0e-\x1f]')"
    return counted(t, "hidden_control_character", cols(t, "str"), pred, 0.98, "'medium'")


def d16(t):
    return counted(t, "unusual_length", cols(t, "str"), "length({c}) > 1024", 0.9)


def d17(t):
    pred = r"{c} IS NOT NULL AND NOT regexp_matches(trim({c}), '^[^@\s]+@[^@\s]+\.[^@\s]+$')"
    return counted(t, "invalid_email", hinted(cols(t, "str"), ("email", "mail", "@")), pred, 0.85)


def d18(t):
    n = "length(regexp_replace({c}, '[^0-9]', '', 'g'))"
    pred = f"{{c}} IS NOT NULL AND ({n} < 7 OR {n} > 15)"
    return counted(t, "invalid_phone", hinted(cols(t, "str"), ("phone", "tel", "mobile")), pred, 0.9)


def d19(t):
    pred = r"{c} IS NOT NULL AND NOT regexp_matches(trim({c}), '^(https?|ftp)://[^\s]+$')"
    return counted(
        t, "invalid_url", hinted(cols(t, "str"), ("url", "website", "web", "link")), pred, 0.9
    )


def d20(t):
    pred = f"{{c}} IS NOT NULL AND NOT regexp_matches(trim({{c}}), '^{OCTET}(\\.{OCTET}){{{{3}}}}$')"
    pred = pred.replace("{{{{", "{{").replace("}}}}", "}}")
    names = [c for c in cols(t, "str") if c == "ip" or hinted([c], ("ip_address", "ip_addr", "ipv4"))]
    return counted(t, "invalid_ip", names, pred, 0.95)


def d21(t):
    pred = "left({c}, 1) IN ('=', '+', '-', '@', chr(9), chr(13))"
    return counted(t, "suspicious_formula_injection", cols(t, "str"), pred, 0.95)


def d22(t):
    return " UNION ALL ".join(
        f"SELECT {row('spelling_variant', repr(c), 'hits', 'hits / CAST(total AS DOUBLE)', 0.8, 0.2, repr('low'))} FROM (SELECT count(*) AS keys, "
        f"sum(n) FILTER (WHERE n / CAST(total AS DOUBLE) >= 0.001) AS hits, max(total) AS total FROM (SELECT k, sum(n) AS n, "
        f"(SELECT count(*) FROM {t}) AS total FROM (SELECT regexp_replace(lower({c}), '[^0-9a-z]+', '', 'g') AS k, {c}, count(*) AS n "
        f"FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE k <> '' GROUP BY k HAVING count(*) >= 2)) WHERE keys >= 2 AND hits > 0"
        for c in cols(t, "str")
    )


def d23(t):
    pred = r"regexp_matches({c}, '[\x{{FF10}}-\x{{FF19}}\x{{FF21}}-\x{{FF3A}}\x{{FF41}}-\x{{FF5A}}]')"
    return counted(t, "fullwidth_character", cols(t, "str"), pred, 0.9)


def d24(t):
    pred = r"regexp_matches({c}, '\x{{FFFD}}')"
    return counted(t, "mojibake_character", cols(t, "str"), pred, 0.95, fpr=0.05)


def d25(t):
    hints = "price amount count quantity qty salary money fee total cost age num".split()
    pred = r"{c} IS NOT NULL AND NOT regexp_matches(trim({c}), '^[+-]?[\d,.\s]+$')"
    return counted(
        t,
        "invalid_numeric",
        hinted(cols(t, "str"), hints, ("date", "time", "timestamp")),
        pred,
        0.85,
        "'medium'",
        0.15,
        f"n >= 2 AND {RATIO} >= 0.01",
        RATIO,
    )


def _bounded(t, detector, conf, stats, bound, more=""):
    return " UNION ALL ".join(
        f"SELECT {row(detector, repr(c), 'n', 'n', conf, 0.1, repr('medium'), more=more)} FROM (SELECT any_value(s) AS s, count(*) AS n "
        f"FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {t} WHERE {c} IS NOT NULL), "
        f"(SELECT {stats.format(c=f'CAST({c} AS DOUBLE)')} AS s FROM {t}) WHERE {bound}) WHERE n > 0"
        for c in cols(t, "num")
    )


def d26(t, evidence=False):
    stats = "{{'a': quantile_cont({c}, 0.25), 'b': quantile_cont({c}, 0.75)}}"
    lower, upper = "s.a - 1.5 * (s.b - s.a)", "s.b + 3.0 * (s.b - s.a)"
    more = f", round({lower}, 6) AS lower_bound, round({upper}, 6) AS upper_bound" if evidence else ""
    return _bounded(
        t, "iqr_outlier", 0.9, stats, f"s.b - s.a > 0 AND (x < {lower} OR x > {upper})", more
    )


def d27(t):
    stats = "{{'a': quantile_cont({c}, 0.001), 'b': quantile_cont({c}, 0.999)}}"
    return _bounded(t, "percentile_outlier", 0.9, stats, "x < s.a OR x > s.b")


def d28(t):
    stats = "{{'a': median({c}), 'b': mad({c})}}"
    return _bounded(
        t, "modified_zscore", 0.8, stats, "s.b <> 0 AND abs(x - s.a) > 0.6745 * s.b * 3.5"
    )


def d29(t):
    return counted(t, "tail_probability", cols(t, "num"), "{c} < 0", 0.95, "'medium'")


def d30(t, min_ratio=1e-5):
    return " UNION ALL ".join(
        f"SELECT {row('histogram_rarity', repr(c), 'hits', 'bins', 0.85, 0.1, repr('medium'))} FROM (SELECT sum(n) AS hits, count(*) AS bins FROM ("
        f"SELECT floor((CAST({c} AS DOUBLE) - lo) / w) AS bin, count(*) AS n, max(lim) AS lim FROM {t}, (SELECT CAST(min({c}) AS DOUBLE) AS lo, "
        f"(CAST(max({c}) AS DOUBLE) - CAST(min({c}) AS DOUBLE)) / 20 AS w, greatest(1, CAST(floor(count({c}) * CAST({min_ratio} AS DOUBLE)) AS BIGINT)) AS lim FROM {t}) "
        f"WHERE w > 0 AND {c} IS NOT NULL GROUP BY bin HAVING count(*) < max(lim))) WHERE hits IS NOT NULL"
        for c in cols(t, "num")
    )


def _date_texts(t):
    return hinted(cols(t, "str"), ("date", "dob", "birth"))


def d32(t):
    pred = "{c} IS NOT NULL AND NOT regexp_matches(trim({c}), '" + ISO + "')"
    return counted(t, "invalid_date", _date_texts(t), pred, 0.9, "'medium'")


def d33(t):
    pred = (
        "{c} IS NOT NULL AND regexp_matches(trim({c}), '" + ISO + "') "
        "AND try_strptime(trim({c}), '%Y-%m-%d') IS NULL"
    )
    return counted(t, "impossible_date", _date_texts(t), pred, 0.95, "'high'")


def d34(t, as_of):
    pred = f"{{c}} > DATE '{as_of}' + INTERVAL 1 DAY"
    return counted(t, "future_date", cols(t, "time"), pred, 0.9)


def d35(t, as_of):
    pred = f"{{c}} < DATE '{as_of}' - INTERVAL 365 DAY"
    names = cols(t, "time")
    skip = hinted(names, "birth dob founded hire established historical history".split())
    return counted(t, "stale_date", [c for c in names if c not in skip], pred, 0.85)


def d36(t):
    kind = (
        r"CASE WHEN regexp_matches(v, '^\d{4}-\d{2}-\d{2}$') THEN 'iso' "
        r"WHEN regexp_matches(v, '^\d{1,2}/\d{1,2}/\d{4}$') THEN 'slash' "
        r"WHEN regexp_matches(v, '^\d{1,2}\.\d{1,2}\.\d{4}$') THEN 'dot' "
        r"WHEN regexp_matches(v, '^\d{8}$') THEN 'compact' ELSE 'other' END"
    )
    return " UNION ALL ".join(
        f"SELECT {row('mixed_date_format', repr(c), 'hits', 'major', 0.85, 0.1, repr('low'))} FROM (SELECT count(*) FILTER (WHERE n > 0.02 * total) AS major, "
        f"sum(n) - max(n) AS hits, max(d) AS d FROM (SELECT kind, count(*) AS n FROM (SELECT {kind} AS kind FROM "
        f"(SELECT trim({c}) AS v FROM {t} WHERE {c} IS NOT NULL)) WHERE kind <> 'other' GROUP BY kind), "
        f"(SELECT count({c}) AS total, count(DISTINCT {c}) AS d FROM {t})) WHERE major >= 2 AND d >= 10"
        for c in _date_texts(t)
    )


def d37(t):
    return " UNION ALL ".join(
        f"SELECT {row('duplicate_timestamp', repr(c), 'hits', 'groups', 0.9, 0.1, repr('medium'))} FROM (SELECT sum(n - 1) AS hits, count(*) AS groups FROM ("
        f"SELECT {c}, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 2)) WHERE hits IS NOT NULL"
        for c in cols(t, "time")
    )


def d38(t, pairs=(("min_qty", "max_qty"),)):
    return " UNION ALL ".join(
        f"SELECT {row('cross_field_rule', repr(a + ',' + b), 'n', 'n', 0.95, 0.1, repr('medium'), issue='cross_field_violation')} FROM "
        f"(SELECT count(*) AS n FROM {t} WHERE {a} > {b}) WHERE n > 0"
        for a, b in pairs
    )


def d39(t, column, ref, ref_column, evidence=False):
    more = ", CAST(total AS BIGINT) AS main_total_non_null" if evidence else ""
    return (
        f"SELECT {row('foreign_key_violation', repr(column), 'n', 'least(100.0 * n / total, 100.0)', 0.95, 0.05, repr('high'), more=more)} FROM ("
        f"SELECT count({column}) AS total, count({column}) FILTER (WHERE {column} NOT IN (SELECT {ref_column} FROM {ref} "
        f"WHERE {ref_column} IS NOT NULL)) AS n FROM {t}) WHERE n > 0"
    )
