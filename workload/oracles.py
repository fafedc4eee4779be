"""The same results in DuckDB SQL, one text per query name."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

K = 4
UNIT = 281474976710656  # 16 ** 12


def uniform(seed: int, *keys: str) -> str:
    text = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"(CAST(CAST('0x' || substr(md5(concat_ws(',', '{seed}', {text})), 1, 12) AS BIGINT) AS DOUBLE) / {UNIT}.0)"


# --- raw columns, counts, dictionaries ---

LINEITEM_FEATURES = [
    "l_returnflag",
    "l_linestatus",
    "CAST(l_linenumber AS VARCHAR)",
    "CAST(nullif(l_discount, 0.0) AS VARCHAR)",
    "CAST(l_quantity AS VARCHAR)",
    "'z'",
    "''",
    "CAST(l_orderkey AS VARCHAR)",
]
FIELDS = [
    ("returnflag", "state"),
    ("linestatus", "state"),
    ("linenumber", "place"),
    ("discount", "price"),
    ("quantity", "price"),
    ("constant", "other"),
    ("empty", "other"),
    ("orderkey", "key"),
]
FLAGS = [0] * len(FIELDS) + [1]
FIELDS.append(("derived", "other"))
SPEC = (
    "(VALUES "
    + ", ".join(f"({i}, '{n}', {flag}, '{f}')" for i, ((n, f), flag) in enumerate(zip(FIELDS, FLAGS)))
    + ") spec(pos, name, flag, family)"
)


def union_cells(features: list[str], table: str, *keep: str) -> str:
    kept = "".join(f"{k}, " for k in keep)
    return " UNION ALL ".join(f"SELECT {kept}{i} AS feature_id, {f} AS value FROM {table}" for i, f in enumerate(features))


def counts_cte(features: list[str] = LINEITEM_FEATURES, table: str = "lineitem") -> str:
    return (
        f"counts AS MATERIALIZED (SELECT feature_id, value, count(*) AS cnt FROM ({union_cells(features, table)}) "
        "WHERE value IS NOT NULL AND value <> '' GROUP BY 1, 2), "
        "sizes AS MATERIALIZED (SELECT feature_id, count(*) AS v_size FROM counts GROUP BY 1)"
    )


def dictionary_cte() -> str:
    """``kept`` and ``dict`` for the cut-offs 2 … 1000, from ``counts`` and ``sizes``."""
    return (
        "kept AS MATERIALIZED (SELECT feature_id AS pos, row_number() OVER (ORDER BY feature_id) - 1 AS feature_id "
        "FROM sizes WHERE v_size BETWEEN 2 AND 1000), "
        "dict AS MATERIALIZED (SELECT kept.feature_id, value, "
        "row_number() OVER (PARTITION BY kept.feature_id ORDER BY value) - 1 AS value_id, cnt "
        "FROM counts JOIN kept ON counts.feature_id = kept.pos)"
    )


LINEITEM_INDEX = f"{counts_cte()}, {dictionary_cte()}"

ORACLES["field_spec_filter"] = """
SELECT p_partkey AS pos, 'part_' || p_partkey AS name, p_type AS family FROM part WHERE p_size <= 25"""
ORACLES["project_tsv_features"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, nullif(o_orderstatus, '') AS status,
       nullif(o_orderpriority, '1-URGENT') AS priority FROM orders"""
ORACLES["feature_value_counts"] = f"WITH {counts_cte()} SELECT * FROM counts"
ORACLES["feature_cardinality"] = f"WITH {counts_cte()} SELECT * FROM sizes"
ORACLES["max_cardinality"] = f"WITH {counts_cte()} SELECT max(v_size) AS max_v_size FROM sizes"
ORACLES["approx_feature_cardinality"] = (
    f"WITH {counts_cte()} SELECT feature_id, v_size, true AS within_5_percent FROM sizes"
)
ORACLES["approx_cardinality_united"] = f"""
WITH {counts_cte(LINEITEM_FEATURES[:6] + LINEITEM_FEATURES[7:])}
SELECT feature_id, v_size, true AS within_5_percent, true AS as_once FROM sizes"""
ORACLES["cutoff_inclusive"] = f"WITH {counts_cte()} SELECT * FROM sizes WHERE v_size >= 2 AND v_size <= 1000"
ORACLES["cutoff_exclusive"] = f"WITH {counts_cte()} SELECT * FROM sizes WHERE v_size > 2 AND v_size <= 1000"
ORACLES["kept_features"] = f"""
WITH {LINEITEM_INDEX}
SELECT feature_id, pos, name, flag, family FROM kept JOIN {SPEC} USING (pos)"""
ORACLES["empty_features"] = f"""
WITH {counts_cte()}
SELECT pos, name, flag, family FROM {SPEC} WHERE flag = 0 AND pos NOT IN (SELECT feature_id FROM sizes)"""
ORACLES["value_dictionary"] = f"WITH {LINEITEM_INDEX} SELECT * FROM dict"
ORACLES["index_grown"] = ORACLES["value_dictionary"]
ORACLES["value_dictionary_uncapped"] = f"""
WITH {counts_cte()}
SELECT feature_id, value, row_number() OVER (PARTITION BY feature_id ORDER BY value) - 1 AS value_id, cnt FROM counts"""

# --- encoding ---

PART_FEATURES = ["p_brand", "nullif(p_type, 'SMALL')", "CAST(p_size AS VARCHAR)"]


def encoded_cte(features: list[str], table: str, *keep: str) -> str:
    """``enc``: kept columns, then ``f0 …``; ``features`` are the kept ones in order and need ``dict``."""
    joins = " ".join(
        f"LEFT JOIN dict d{i} ON d{i}.feature_id = {i} AND d{i}.value = {f}" for i, f in enumerate(features)
    )
    ids = [f"CAST(d{i}.value_id AS INTEGER) AS f{i}" for i in range(len(features))]
    return f"enc AS MATERIALIZED (SELECT {', '.join([*keep, *ids])} FROM {table} {joins})"


PART_ENCODED = f"{counts_cte(PART_FEATURES, 'part')}, {dictionary_cte()}, {encoded_cte(PART_FEATURES, 'part', 'p_partkey')}"
LINEITEM_ENCODED = f"{LINEITEM_INDEX}, {encoded_cte(LINEITEM_FEATURES[:5], 'lineitem')}"
ORDER_FEATURES = ["CAST(o_custkey AS VARCHAR)", "strftime(o_orderdate, '%Y-%m-%d')", "nullif(o_orderpriority, '5-LOW')"]

ORACLES["encode_features"] = f"WITH {PART_ENCODED} SELECT * FROM enc"
ORACLES["encode_large_dictionary"] = f"""
WITH {counts_cte(ORDER_FEATURES, 'orders')},
dict AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY value) - 1 AS value_id FROM counts),
{encoded_cte(ORDER_FEATURES, 'orders', 'o_orderkey')} SELECT * FROM enc"""
ORACLES["recode_grown"] = ORACLES["recode_grown_large"] = ORACLES["encode_large_dictionary"]
ORACLES["encoded_value_counts"] = f"WITH {LINEITEM_INDEX} SELECT feature_id, value_id, cnt FROM dict"
ORACLES["vector_text"] = f"""
WITH {PART_ENCODED}
SELECT p_partkey, concat_ws(' ', coalesce(f0, -1), coalesce(f1, -1), coalesce(f2, -1)) AS line FROM enc"""
ORACLES["out_of_domain_cells"] = """
WITH found AS (SELECT 0 AS feature_id, l_linenumber AS value_id FROM lineitem
               UNION ALL SELECT 1, CAST(l_quantity AS INTEGER) FROM lineitem),
domain AS (SELECT 0 AS feature_id, s_nationkey AS value_id FROM supplier UNION SELECT 1, c_nationkey FROM customer)
SELECT feature_id, value_id, count(*) AS cells FROM found
WHERE NOT EXISTS (SELECT 1 FROM domain d WHERE d.feature_id = found.feature_id AND d.value_id = found.value_id)
GROUP BY 1, 2"""

# --- text ---

TLD = "com|net|gov|org|edu|co|biz|tv|info"


def unescape(text: str) -> str:
    return f"""array_to_string(list_transform(
      regexp_extract_all({text}, '&(?:lt|gt|amp|quot|apos|#[0-9]+|#[xX][0-9a-fA-F]+);|[^&]+|&'),
      lambda t: CASE t WHEN '&lt;' THEN '<' WHEN '&gt;' THEN '>' WHEN '&amp;' THEN '&' WHEN '&quot;' THEN '"'
        WHEN '&apos;' THEN '''' ELSE CASE
        WHEN regexp_full_match(t, '&#[xX][0-9a-fA-F]+;') THEN chr(CAST('0x' || t[4:-2] AS INTEGER))
        WHEN regexp_full_match(t, '&#[0-9]+;') THEN chr(CAST(t[3:-2] AS INTEGER)) ELSE t END END), '')"""


def strong(text: str) -> str:
    return rf"regexp_replace({text}, '(?i)(<strong.*?>)(.+?)(</strong>)', '\2', 'g')"


def web(text: str) -> str:
    www = rf"regexp_replace({text}, '(?i)(www\.)(.+?)(\.({TLD}))', '\2', 'g')"
    return rf"regexp_replace({www}, '(?i)(.+?)(\.({TLD}))', '\1', 'g')"


def normalized(text: str) -> str:
    plain = web(strong(unescape(f"lower({text})")))
    return (
        f"regexp_replace(regexp_replace(regexp_replace({plain}, '[[:punct:]]', ' ', 'g'), '[0-9]+', ' ', 'g'), ' +', ' ', 'g')"
    )


LINES = r"""lines AS (SELECT doc_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS value FROM (
  SELECT doc_id, string_split_regex(regexp_replace(text, '(\r\n|\r|\n)$', ''), '\r\n|\r|\n') AS parts
  FROM documents WHERE text <> ''))"""

ORACLES["row_width_audit_lines"] = f"""
WITH {LINES}, widths AS (SELECT len(string_split(value, ' ')) AS width FROM lines)
SELECT width, count(*) AS lines, width = 8 AS is_valid FROM widths GROUP BY width"""
ORACLES["row_widths_observed"] = f"""
WITH {LINES}, widths AS (SELECT len(string_split(value, ' ')) AS width FROM lines)
SELECT 'lines' AS width, count(*) AS lines FROM widths UNION ALL SELECT 'wider', count(*) FROM widths WHERE width > 8
UNION ALL SELECT 'cells_' || n, count(width) FROM range(1, 8) r(n) LEFT JOIN widths ON width = n GROUP BY n"""
ORACLES["unescape_xml"] = f"""
SELECT page_id, {unescape("replace(replace(html, '&middot;', '&#183;'), '&copy;', '&#xA9;')")} AS text FROM pages"""
ORACLES["strip_strong"] = rf"""
SELECT page_id, {strong(r"regexp_replace(html, '<(/?)(?:b|h1)>', '<\1strong>', 'g')")} AS text FROM pages"""
ORACLES["strip_web_address"] = f"SELECT page_id, {web('url')} AS text FROM pages"
ORACLES["normalize_text"] = f"WITH {LINES} SELECT doc_id, line_no, {normalized('value')} AS text FROM lines"
ORACLES["extract_text_fields"] = rf"""
WITH flat AS (SELECT page_id, url, regexp_replace(html, '\s', ' ', 'g') AS body FROM pages),
titled AS (SELECT *, regexp_extract(body, '<title>(.*?)</title>', 1) AS title FROM flat),
clean AS (SELECT page_id, {normalized('title')} AS title, {normalized('body')} AS body, {normalized('url')} AS url FROM titled)
SELECT page_id, title AS "exactCanonicalQuery", title, body AS description, url AS "displayUrl", url AS "targetUrl",
  regexp_replace(title || chr(9) || title || chr(9) || body || chr(9) || url || chr(9) || url,
                 '^[\x01-\x20]+|[\x01-\x20]+$', '', 'g') AS line FROM clean"""
ORACLES["word_count"] = f"""
WITH {LINES}, words AS (SELECT unnest(CASE WHEN value = '' THEN [''] WHEN rtrim(value, ' ') = '' THEN []
  ELSE string_split(rtrim(value, ' '), ' ') END) AS word FROM lines)
SELECT word, count(*) AS cnt FROM words GROUP BY 1"""
ORACLES["line_index"] = f"""
WITH {LINES} SELECT row_number() OVER (ORDER BY value, doc_id, line_no) AS line_id, value FROM lines"""

# --- mixture model ---


def patterns_cte(features: int, *keep: str) -> str:
    """``cells(r, w, feature_id, value_id)``, ``masses(r, w)`` and ``domain`` from ``enc``."""
    ids = [f"f{i}" for i in range(features)]
    if keep:
        pat = f"SELECT {keep[0]} AS r, 1 AS w, {', '.join(ids)} FROM enc"
    else:
        pat = f"SELECT row_number() OVER () AS r, * FROM (SELECT {', '.join(ids)}, count(*) AS w FROM enc GROUP BY ALL)"
    union = " UNION ALL ".join(f"SELECT r, w, {i} AS feature_id, f{i} AS value_id FROM pat WHERE f{i} IS NOT NULL" for i in range(features))
    return (
        f"pat AS MATERIALIZED ({pat}), cells AS MATERIALIZED ({union}), "
        "domain AS MATERIALIZED (SELECT DISTINCT feature_id, value_id FROM cells), "
        f"grid AS MATERIALIZED (SELECT feature_id, value_id, k, count(*) OVER (PARTITION BY feature_id, k) AS v_size "
        f"FROM domain, (SELECT unnest(range({K})) AS k) ks)"
    )


ARITHMETIC = "1 + (31 * feature_id + 17 * value_id + 7 * k + 3 * value_id * k) % 11"


def start_cte(x: str = ARITHMETIC) -> str:
    return (
        f"theta0 AS MATERIALIZED (SELECT feature_id, value_id, k, x / sum(x) OVER (PARTITION BY feature_id, k) AS p "
        f"FROM (SELECT *, CAST({x} AS DOUBLE) AS x FROM grid)), "
        f"prior0 AS MATERIALIZED (SELECT unnest(range({K})) AS k, 1.0::DOUBLE / {K} AS p)"
    )


def posterior_cte(i: int) -> str:
    return (
        f"logs{i} AS MATERIALIZED (SELECT r, w, t.k, sum(ln(t.p)) + any_value(ln(q.p)) AS z FROM cells "
        f"JOIN theta{i} t USING (feature_id, value_id) JOIN prior{i} q ON q.k = t.k GROUP BY r, w, t.k), "
        f"raised{i} AS MATERIALIZED (SELECT r, w, k, exp(z - max(z) OVER (PARTITION BY r)) AS e FROM logs{i}), "
        f"post{i} AS MATERIALIZED (SELECT r, w, k, e / sum(e) OVER (PARTITION BY r) AS p FROM raised{i}), "
        f"best{i} AS MATERIALIZED (SELECT r, w, k, 1.0::DOUBLE AS p FROM "
        f"(SELECT *, row_number() OVER (PARTITION BY r ORDER BY p DESC, k) AS place FROM post{i}) WHERE place = 1)"
    )


def statistics_cte(i: int, hard: bool, per: str) -> str:
    source = f"best{i}" if hard else f"post{i}"
    mass = (
        f"SELECT k, sum(n) AS mass FROM stats{i} GROUP BY k"
        if per == "cells"
        else f"SELECT k, sum(w * p) AS mass FROM {source} GROUP BY k"
    )
    return (
        f"found{i} AS MATERIALIZED (SELECT feature_id, value_id, k, sum(s.w * p) AS n FROM cells JOIN {source} s USING (r) "
        f"GROUP BY 1, 2, 3), "
        f"stats{i} AS MATERIALIZED (SELECT feature_id, value_id, k, v_size, coalesce(n, 0.0) AS n "
        f"FROM grid LEFT JOIN found{i} USING (feature_id, value_id, k)), mass{i} AS MATERIALIZED ({mass})"
    )


def update_cte(i: int, alpha: float | None = None, beta: float | None = None) -> str:
    a = f"{alpha or 1 / K}::DOUBLE"
    b, total = ("1.0::DOUBLE / v_size", "1") if beta is None else (f"{beta}::DOUBLE", f"{beta}::DOUBLE * v_size")
    return (
        f"theta{i + 1} AS MATERIALIZED (SELECT feature_id, value_id, k, "
        f"({b} + n) / ({total} + sum(n) OVER (PARTITION BY feature_id, k)) AS p FROM stats{i}), "
        f"prior{i + 1} AS MATERIALIZED (SELECT k, ({a} + coalesce(mass, 0)) / ({a} * {K} + sum(mass) OVER ()) AS p "
        f"FROM prior0 LEFT JOIN mass{i} USING (k))"
    )


def fit_cte(iterations: int, hard: bool = False, per: str = "cells", **pseudo: float) -> str:
    steps = [
        part
        for i in range(iterations)
        for part in (posterior_cte(i), statistics_cte(i, hard, per), update_cte(i, **pseudo))
    ]
    return ", ".join([start_cte(), *steps])


LINEITEM_MODEL = f"{LINEITEM_ENCODED}, {patterns_cte(5)}"
PART_MODEL = f"{PART_ENCODED}, {patterns_cte(3, 'p_partkey')}"
ROUNDED = "round({0}, 6) + 0.0"


def rounded(column: str, name: str | None = None) -> str:
    return f"round({column}, 6) + 0.0 AS {name or column}"


THETA = f"SELECT feature_id, value_id, k, {rounded('p')} FROM "

ORACLES["nb_init"] = f"""
WITH {LINEITEM_MODEL}, {start_cte(uniform(7, 'feature_id', 'value_id', 'k'))},
draws AS (SELECT k, {uniform(7, "'prior'", 'k')} AS u FROM prior0)
{THETA} theta0 UNION ALL SELECT -1, 0, k, {rounded('u / sum(u) OVER ()', 'p')} FROM draws"""
ORACLES["nb_init_uniform"] = f"""
WITH {LINEITEM_MODEL} SELECT feature_id, value_id, k, {rounded('1.0::DOUBLE / v_size', 'p')} FROM grid
UNION ALL SELECT -1, 0, unnest(range({K})), {1 / K}"""
POSTERIOR = f"WITH {PART_MODEL}, {start_cte()}, {posterior_cte(0)}"
ORACLES["nb_posterior"] = f"{POSTERIOR} SELECT r AS p_partkey, k, {rounded('p')} FROM post0"
ORACLES["nb_posterior_joined"] = ORACLES["nb_posterior"]
ORACLES["nb_assign_argmax"] = f"{POSTERIOR} SELECT r AS p_partkey, k AS cluster FROM best0"
ORACLES["nb_assign_sampled"] = f"""
{POSTERIOR}, reached AS (SELECT r, k, sum(p) OVER (PARTITION BY r ORDER BY k) AS cum FROM post0)
SELECT r AS p_partkey, min(k) AS cluster FROM reached WHERE cum >= {uniform(3, 'r')} GROUP BY r"""
SOFT = f"WITH {LINEITEM_MODEL}, {start_cte()}, {posterior_cte(0)}, {statistics_cte(0, False, 'cells')}"
HARD = f"WITH {LINEITEM_MODEL}, {start_cte()}, {posterior_cte(0)}, {statistics_cte(0, True, 'cells')}"
STATISTICS = f"SELECT feature_id, value_id, k, {rounded('n')} FROM stats0"
ORACLES["nb_soft_stats"] = f"{SOFT} {STATISTICS}"
ORACLES["nb_soft_stats_joined"] = ORACLES["nb_soft_stats"]
ORACLES["nb_hard_stats"] = f"{HARD} {STATISTICS}"
ORACLES["nb_prior_cells"] = f"{SOFT} SELECT k, {rounded('mass')} FROM mass0"
ORACLES["nb_prior_records"] = f"""
WITH {LINEITEM_MODEL}, {start_cte()}, {posterior_cte(0)}, {statistics_cte(0, False, 'records')}
SELECT k, {rounded('mass')} FROM mass0"""
ORACLES["nb_mstep"] = f"{SOFT}, {update_cte(0)} {THETA} theta1"


def model(iterations: int, **options) -> str:
    last = f"{THETA} theta{iterations} UNION ALL SELECT -1, 0, k, {rounded('p')} FROM prior{iterations}"
    return f"WITH {LINEITEM_MODEL}, {fit_cte(iterations, **options)} {last}"


ORACLES["nb_train_soft"] = model(3)
ORACLES["nb_train_hard"] = model(2, hard=True)
ORACLES["nb_train_records"] = model(2, per="records")
ORACLES["nb_train_pseudo_counts"] = model(2, alpha=0.75, beta=0.25)
ORACLES["nb_trace"] = f"WITH {LINEITEM_MODEL}, {fit_cte(2)} " + " UNION ALL ".join(
    f"SELECT {i + 1} AS iter, feature_id, value_id, k, {rounded('n')}, {rounded('t.p', 'p')} "
    f"FROM stats{i} JOIN theta{i + 1} t USING (feature_id, value_id, k) "
    f"UNION ALL SELECT {i + 1}, -1, 0, k, NULL, {rounded('p')} FROM prior{i + 1}"
    for i in range(2)
)
ORACLES["nb_score"] = f"""
WITH {PART_MODEL}, {fit_cte(2)}, {posterior_cte(2)} SELECT r AS p_partkey, k, {rounded('p')} FROM post2"""

ORACLES["nb_saved_model_score"] = ORACLES["nb_score"]

# --- vectors, logistic regression ---

ORACLES["parse_vectors_scan"] = ORACLES["encode_features"]
ORACLES["vectors_checked"] = """
WITH cells AS (SELECT CAST(l_linenumber AS VARCHAR) AS c0, CASE l_discount WHEN 0.05 THEN 'x' || CAST(l_quantity AS INTEGER)
    WHEN 0.02 THEN '' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS c1,
  CAST(CAST(l_orderkey AS BIGINT) * 10000000 AS VARCHAR) AS c2 FROM lineitem),
ids AS (SELECT *, TRY_CAST(c0 AS INTEGER) AS f0, TRY_CAST(nullif(c1, '') AS INTEGER) AS f1, TRY_CAST(c2 AS INTEGER) AS f2,
  CASE WHEN c1 LIKE 'x%' THEN '1: not_a_number' WHEN f2 IS NULL THEN '2: out_of_range' END AS fault FROM cells)
SELECT f0, f1, f2, fault, CASE WHEN fault IS NOT NULL THEN concat(c0, ' ', c1, ' ', c2) END AS line FROM ids"""
ORACLES["labelled_checked"] = f"""
WITH points AS (SELECT CASE l_returnflag WHEN 'R' THEN 1.0::DOUBLE WHEN 'A' THEN -1.0::DOUBLE END AS y,
  CAST(l_linenumber AS DOUBLE) AS a, CASE WHEN l_tax <= 0.05 AND l_tax NOT IN (0.03, 0.04) THEN (l_linenumber + 0.5) * 10.0::DOUBLE END AS b,
  CASE WHEN y IS NULL THEN '0: not_a_number' WHEN l_tax = 0.03 THEN '2: not_a_number' WHEN l_tax = 0.04 THEN '2: out_of_range'
    WHEN l_tax > 0.05 THEN 'too_few_numbers' END AS fault FROM lineitem)
SELECT y, fault, count(*) AS n, count(fault) AS lines, {rounded('sum(a)', 'x0')}, {rounded('sum(b)', 'x1')}
FROM points GROUP BY 1, 2"""
ORACLES["labelled_scan"] = f"""
SELECT CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y, count(*) AS n, 3 AS dimensions,
  {rounded('sum(CAST(CAST(l_quantity AS INTEGER) AS DOUBLE))', 'x0')}, {rounded('sum(CAST(l_linenumber AS DOUBLE))', 'x1')},
  {rounded('sum(7.0::DOUBLE)', 'x2')} FROM lineitem GROUP BY 1"""

ORACLES["vector_sum"] = f"""
WITH parts AS (SELECT label, len(embedding) AS n, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x
  FROM embeddings)
SELECT label, i, {rounded('sum(x)', 'total')} FROM
  (SELECT label, i, x FROM parts UNION ALL SELECT label, n - 1 - i, x FROM parts) GROUP BY 1, 2"""

POINTS = """points AS MATERIALIZED (SELECT CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y,
  l_quantity / 50 AS x0, l_extendedprice / 100000 AS x1, l_discount * 10 AS x2, l_tax * 10 AS x3,
  l_linenumber / 7.0::DOUBLE AS x4 FROM lineitem),
w0 AS MATERIALIZED (SELECT 0.1::DOUBLE AS w0, -0.2::DOUBLE AS w1, 0.3::DOUBLE AS w2, -0.4::DOUBLE AS w3, 0.5::DOUBLE AS w4)"""


def gradient_cte(i: int) -> str:
    score = " + ".join(f"w{j} * x{j}" for j in range(5))
    sums = ", ".join(f"sum(slope * x{j}) AS g{j}" for j in range(5))
    return (
        f"g{i} AS MATERIALIZED (SELECT {sums} FROM (SELECT *, (1 / (1 + exp(-y * ({score}))) - 1) * y AS slope "
        f"FROM points, w{i}))"
    )


def step_cte(i: int) -> str:
    moved = ", ".join(f"w{j} - 0.00001::DOUBLE * g{j} AS w{j}" for j in range(5))
    return f"w{i + 1} AS MATERIALIZED (SELECT {moved} FROM w{i}, g{i})"


ORACLES["logreg_gradient"] = (
    f"WITH {POINTS}, {gradient_cte(0)} SELECT " + ", ".join(rounded(f"g{j}") for j in range(5)) + " FROM g0"
)
ORACLES["logreg_train"] = (
    f"WITH {POINTS}, "
    + ", ".join(f"{gradient_cte(i)}, {step_cte(i)}" for i in range(3))
    + " "
    + " UNION ALL ".join(f"SELECT {j} AS i, {rounded(f'w{j}', 'w')} FROM w3" for j in range(5))
)
ORACLES["nb_train_resumed"] = ORACLES["nb_train_soft"]
