"""SQL counterparts of the registered queries, for an engine that shares no code with Spark.

Inputs come from the same projection expressions; everything after that is
written independently as plain SQL.
"""

from __future__ import annotations

from bidloom.plans import inputs as I


def cols(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in columns.items())


ITEMS = f"items AS (SELECT {cols(I.ITEM_COLUMNS)} FROM part)"
HEADER = ("vendor", "vendor_ord", "source_file", "document_currency", "freight_included")


def vendors(level: str) -> str:
    if level == "house":
        return f"resp AS (SELECT {cols(I.HOUSE_COLUMNS)} FROM region)"
    return f"resp AS (SELECT {cols(I.SUPPLIER_COLUMNS)} FROM supplier)"


def lines(level: str) -> str:
    source = "lineitem JOIN supplier ON l_suppkey = s_suppkey"
    columns = I.SUPPLIER_COLUMNS
    if level == "house":
        source += " JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
        columns = I.HOUSE_COLUMNS
    return f"lines AS (SELECT {cols({k: columns[k] for k in HEADER})}, {cols(I.LINE_COLUMNS)} FROM {source})"


MATCHED = r"""
coded AS (SELECT *, COALESCE(
    CASE WHEN regexp_full_match(upper(trim(vendor_sku)), '[A-Z]{2,5}[\s_-]{0,2}\d{1,6}')
         THEN concat(regexp_extract(upper(trim(vendor_sku)), '^[A-Z]+'), '-', lpad(regexp_extract(vendor_sku, '\d+$'), CAST(greatest(3, length(regexp_extract(vendor_sku, '\d+$'))) AS INTEGER), '0')) END,
    nullif(regexp_extract(upper(description), '[A-Z]{2,5}-\d{1,6}'), '')) AS code FROM lines),
matched AS (SELECT c.*, i.sku AS rfx_sku, i.canonical_unit, i.unit_family, i.line_no,
    CASE WHEN i.sku IS NULL THEN NULL WHEN upper(trim(vendor_sku)) = code THEN 'exact_sku' ELSE 'normalized_sku' END AS match_basis,
    CASE WHEN i.sku IS NULL THEN NULL WHEN upper(trim(vendor_sku)) = code THEN 1.0::DOUBLE ELSE 0.97::DOUBLE END AS match_confidence
    FROM coded c LEFT JOIN items i ON c.code = i.sku),
placed AS (SELECT * FROM matched WHERE rfx_sku IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY vendor, rfx_sku ORDER BY match_confidence DESC, line_ord, line_id) = 1)"""

R4 = "floor(({}) * 1e4 + 0.5) / 1e4"
R2 = "floor(({}) * 100.0 + 0.5) / 100.0"
RATE = "CASE cur WHEN 'INR' THEN 1.0 WHEN 'USD' THEN 87.5 WHEN 'EUR' THEN 94.2 WHEN 'GBP' THEN 111.4 END"


def money(value: str, currency: str) -> str:
    symbol = f"CASE {currency} WHEN 'INR' THEN '₹' WHEN 'USD' THEN '$' WHEN 'EUR' THEN '€' WHEN 'GBP' THEN '£' END"
    amount = f"format('{{:,.2f}}', {value})"
    return f"CASE WHEN {symbol} IS NOT NULL THEN concat({symbol}, {amount}) ELSE trim(concat({amount}, ' ', COALESCE({currency}, ''))) END"


def cells(rate: str = RATE, as_of: str = "2026-01-01") -> str:
    return f"""
read AS (SELECT *, quoted_value IS NULL AS silent,
    CASE WHEN unit_text IN ('per box', 'Nos', 'per 100 pcs') THEN 'discrete' WHEN unit_text = 'per roll' THEN 'roll' WHEN unit_text = 'per kg' THEN 'weight' END AS fam,
    CASE unit_text WHEN 'per 100 pcs' THEN 100.0 WHEN '/ 1,000' THEN 1000.0 ELSE 1.0 END::DOUBLE AS pack,
    COALESCE(CASE currency WHEN 'Rs.' THEN 'INR' WHEN '$' THEN 'USD' END, CASE document_currency WHEN 'usd' THEN 'USD' WHEN '€' THEN 'EUR' ELSE document_currency END) AS said_cur
    FROM placed),
rated AS (SELECT *, ({rate.replace('cur', "COALESCE(said_cur, 'INR')")})::DOUBLE AS fx, COALESCE(said_cur, 'INR') AS cur,
    NOT silent AND COALESCE(fam = 'weight' AND unit_family <> 'weight', false) AS heavy FROM read),
judged AS (SELECT *, silent OR heavy AS refused, NOT (silent OR heavy) AND COALESCE(fam <> unit_family, false) AS crossed,
    NOT (silent OR heavy) AND fam IS NULL AS famless, NOT (silent OR heavy) AND said_cur IS NULL AS curless,
    NOT (silent OR heavy) AND cur <> 'INR' AND fx IS NULL AS rateless FROM rated),
flagged AS (SELECT *, list_filter([
    CASE WHEN condition_2 IS NOT NULL THEN 'unquantified_adder' END,
    CASE WHEN condition_1 IS NOT NULL OR notes <> '' THEN 'subject_to_confirmation' END,
    CASE WHEN condition_1 IS NOT NULL THEN 'conditional_price' END,
    CASE WHEN freight_included = false THEN 'freight_excluded' END,
    CASE WHEN famless THEN 'assumed_family' END, CASE WHEN crossed THEN 'cross_basis' END, CASE WHEN curless THEN 'currency_assumed' END
    ], lambda x: x IS NOT NULL) AS flag_list,
    condition_1 IS NOT NULL OR condition_2 IS NOT NULL OR notes <> '' OR crossed AS conditional,
    nullif(concat_ws('; ', condition_1, condition_2, condition_3), '') AS said FROM judged),
cells AS (SELECT rfx_sku, vendor, quoted_value AS original_value, unit_text AS original_unit, CASE WHEN NOT silent THEN said_cur END AS original_currency,
    CASE WHEN NOT refused AND NOT rateless THEN {R4.format("quoted_value / pack * CASE WHEN cur <> 'INR' THEN fx ELSE 1.0 END")} END AS canonical_value,
    CASE WHEN NOT refused AND NOT rateless THEN nullif(concat_ws('  ',
        CASE WHEN pack > 1 THEN concat('÷ ', CAST(CAST(pack AS BIGINT) AS VARCHAR), ' (', unit_text, ' → ', canonical_unit, ')') END,
        CASE WHEN cur <> 'INR' THEN concat('× ', CAST(fx AS VARCHAR), ' INR/', cur, ' @ {as_of}') END), '') END AS factor,
    CASE WHEN silent THEN '' WHEN heavy THEN 'weight_basis_unconvertible' ELSE concat_ws(',',
        CASE WHEN famless THEN 'family_assumed_from_rfx' WHEN crossed THEN 'cross_basis_mismatch' ELSE 'unit_alias' END,
        CASE WHEN pack > 1 THEN 'pack_multiple' END, CASE WHEN curless THEN 'currency_assumed_from_rfx' END,
        CASE WHEN rateless THEN 'unknown_currency' WHEN cur <> 'INR' THEN 'fx_conversion' END) END AS rules,
    CASE WHEN refused THEN 'Unresolved' WHEN rateless OR conditional THEN 'Needs Review'
         WHEN pack > 1 OR cur <> 'INR' OR famless OR curless THEN 'Normalized' ELSE 'Confirmed' END AS status,
    array_to_string(flag_list, ',') AS flags, flag_list, line_id, line_no, canonical_unit, cur, notes, said, silent, heavy, rateless, crossed, fam, unit_family, famless, curless, pack,
    match_basis, match_confidence, confidence, source_file, source_locator, source_snippet, currency, document_currency, unit_text FROM flagged),
cell AS (SELECT *, CASE WHEN canonical_value IS NOT NULL AND status IN ('Confirmed', 'Normalized') THEN 1 ELSE 0 END AS comparable,
    CASE WHEN silent THEN COALESCE(said, nullif(notes, ''), 'The vendor referenced this line but did not state a price.')
      WHEN heavy THEN concat('Quoted ', {money('original_value', 'original_currency')}, ' ', unit_text, ', but the RFx asks for a price ', canonical_unit, '. Converting weight to pieces needs the unit weight of this item, which appears in neither the RFx nor this response.')
      WHEN rateless THEN concat('Quoted in ', cur, ', for which no conversion rate is configured.')
      WHEN crossed THEN concat('Vendor quoted ', unit_text, ' (', fam, ') but the RFx line is priced ', canonical_unit, ' (', unit_family, '). The number is shown but excluded from price comparisons.')
      WHEN status = 'Needs Review' THEN COALESCE(said, 'Price carries an unresolved condition.')
      WHEN pack > 1 OR cur <> 'INR' THEN concat('Converted from “', COALESCE(unit_text, ''), '” to ', canonical_unit, '.')
      WHEN famless AND curless THEN 'Unit not stated in source, assumed to be the rfx unit; currency not stated anywhere in the document, assumed inr from the rfx.'
      WHEN famless THEN 'Unit not stated in source, assumed to be the rfx unit.'
      WHEN curless THEN 'Currency not stated anywhere in the document, assumed inr from the rfx.'
      ELSE 'Quoted directly on the RFx basis.' END AS reason,
    CASE WHEN silent THEN concat('a stated price for ', rfx_sku) WHEN heavy THEN concat('unit weight in kg of one ', replace(canonical_unit, 'per ', ''), ' of ', rfx_sku)
      WHEN rateless THEN concat(cur, '/INR rate') END AS missing_datum FROM cells)"""


def base(level: str, **kw) -> str:
    return f"WITH {ITEMS}, {vendors(level)}, {lines(level)}, {MATCHED.strip()}, {cells(**kw).strip()}"


OFFERS = "offers AS (SELECT rfx_sku, vendor, canonical_value AS price FROM cell WHERE comparable = 1)"
AWARD = f"""{OFFERS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY rfx_sku ORDER BY price, vendor) AS rn, count(*) OVER (PARTITION BY rfx_sku) AS k FROM offers),
won AS (SELECT i.sku AS rfx_sku, i.description, i.quantity, a.vendor AS winner, a.price, b.vendor AS runner_up, b.price AS runner_up_price, COALESCE(a.k, 0) AS contenders,
    {R4.format('b.price - a.price')} AS saving_per_unit, {R2.format('a.price * nullif(i.quantity, 0)')} AS extended,
    CASE WHEN a.vendor IS NULL THEN 'no_comparable' WHEN a.k = 1 THEN 'single_source' ELSE 'awarded' END AS status
    FROM items i LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) a ON i.sku = a.rfx_sku LEFT JOIN (SELECT * FROM ranked WHERE rn = 2) b ON i.sku = b.rfx_sku),
award AS (SELECT *, {R2.format('saving_per_unit * nullif(quantity, 0)')} AS extended_saving FROM won)"""
BASKET = f"""
basket AS (SELECT rfx_sku FROM offers GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM resp)),
qty AS (SELECT sku, CASE WHEN COALESCE(quantity, 0) = 0 THEN 1 ELSE quantity END AS q, COALESCE(quantity, 0) <> 0 AS known FROM items),
single AS (SELECT o.vendor, {R2.format('CAST(sum(CAST(o.price * q AS DECIMAL(28,4))) AS DOUBLE)')} AS total FROM offers o JOIN basket USING (rfx_sku) JOIN qty ON sku = rfx_sku GROUP BY 1),
best AS (SELECT vendor, total FROM single JOIN resp USING (vendor) ORDER BY total, vendor_ord LIMIT 1),
split AS (SELECT count(*) AS common_basket, {R2.format('CAST(sum(CAST(price * q AS DECIMAL(28,4))) AS DOUBLE)')} AS s, COALESCE(bool_and(known), true) AS known FROM award JOIN basket USING (rfx_sku) JOIN qty ON sku = rfx_sku),
versus AS (SELECT common_basket, CASE WHEN common_basket > 0 THEN s END AS split_on_common, CASE WHEN common_basket > 0 THEN (SELECT vendor FROM best) END AS best_single_vendor,
    CASE WHEN common_basket > 0 THEN (SELECT total FROM best) END AS best_single_total, known AS common_quantities_known FROM split),
vs AS (SELECT *, {R2.format('best_single_total - split_on_common')} AS saving_vs_single FROM versus),
vsx AS (SELECT *, saving_vs_single / nullif(best_single_total, 0) AS saving_share FROM vs)"""
PLAN = """
tot AS (SELECT count(*) AS items, count(winner) AS awarded_lines, count(*) FILTER (status = 'single_source') AS single_source_lines, count(*) FILTER (status = 'no_comparable') AS unawardable,
    count(DISTINCT winner) AS supplier_count, CAST(sum(CAST(extended AS DECIMAL(28,2))) AS DOUBLE) AS total_extended, NULL::DOUBLE AS consolidation_cost,
    count(extended) = count(winner) AND count(extended) > 0 AS quantities_known FROM award),
plan AS (SELECT tot.*, vsx.*, items - common_basket AS outside_basket FROM tot, vsx)"""

ANSWERED = (
    "fig AS (SELECT l_suppkey, " + cols(I.ANSWER_FIGURES) + " FROM lineitem GROUP BY 1), asked AS ("
    + " UNION ALL ".join(
        f"SELECT s_name AS vendor, CAST(s_suppkey AS BIGINT) AS vendor_ord, CAST({i} AS BIGINT) AS question_ord, '{k}' AS key, {q} AS question, CAST({a} AS VARCHAR) AS answer, "
        f"CAST({v} AS VARCHAR) AS stated, CAST({e} AS VARCHAR) AS ev, CAST({n} AS VARCHAR) AS note FROM supplier JOIN fig ON s_suppkey = l_suppkey"
        for i, (k, q, a, v, e, n) in enumerate(I.ASKED, 1)
    )
    + ")"
)


# How a question of these suppliers reads: kind, direction, target and unit.
READING = {
    "kind": "CASE WHEN question ILIKE '%iso%' THEN 'certification' WHEN regexp_matches(question, '[0-9]') THEN 'threshold' ELSE 'other' END",
    "direction": "CASE WHEN question ILIKE '%iso%' OR NOT regexp_matches(question, '[0-9]') THEN 'boolean' WHEN regexp_matches(question, 'below|under|30-day') THEN 'lower_better' ELSE 'higher_better' END",
    "threshold": "CASE WHEN question ILIKE '%iso%' THEN NULL ELSE CAST(nullif(regexp_extract(replace(question, ',', ''), '[0-9]+'), '') AS DOUBLE) END",
    "unit": "CASE WHEN question LIKE '%\\%%' ESCAPE '\\' THEN '%' WHEN question ILIKE '%month%' THEN ' units/month' WHEN question LIKE '%day%' THEN ' days' END",
}
SLUG = "array_to_string(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: w NOT IN ('are', 'you', 'held', 'able', 'to', 'a', 'per', 'on'))[1:4], '_')"
# Wordings of one criterion are one requirement; the earliest names the cluster.
CLUSTERS = """wordings AS (SELECT key AS same, question, min((vendor_ord, question_ord)) AS rank, count(*) AS asked FROM asked GROUP BY 1, 2),
clusters AS (SELECT question, rank, asked, first_value(question) OVER (PARTITION BY same ORDER BY rank) AS root,
    len(regexp_extract_all(question, '[A-Za-z][A-Za-z''\\-]*')) - 2 * len(list_filter(regexp_extract_all(question, '[A-Za-z][A-Za-z''\\-]*'), lambda w: w = upper(w) AND length(w) BETWEEN 2 AND 5)) AS spelled FROM wordings)"""


def reading() -> str:
    return ", ".join(f"{e} AS {n}" for n, e in READING.items())


def lit(v) -> str:
    return "NULL" if v is None else (f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE")


def criteria(changes: dict | None = None) -> str:
    rows = []
    for k, q, dr, t, u, r, w in I.CRITERIA:
        if changes and k in changes:
            r, t, w = changes[k]
        rows.append(f"SELECT '{k}' AS key, {lit(q)} AS question, {lit(dr)} AS direction, {lit(t)}::DOUBLE AS target, {lit(u)}::VARCHAR AS unit, {lit(r)} AS requirement, {lit(w)} AS weight")
    return "crit AS (" + " UNION ALL ".join(rows) + ")"


SCORED = """
said AS (SELECT *, CASE WHEN lower(COALESCE(answer, 'unanswered')) = 'yes' THEN 'Yes' WHEN lower(COALESCE(answer, 'unanswered')) = 'no' THEN 'No'
    WHEN lower(COALESCE(answer, 'unanswered')) = 'unanswered' THEN 'Unanswered' ELSE 'Partial' END AS verdict,
    CAST(nullif(regexp_extract(replace(stated, ',', ''), '[0-9]+(\\.[0-9]+)?'), '') AS DOUBLE) AS value FROM asked),
tested AS (SELECT s.*, c.question AS cq, c.direction, c.target, c.requirement, c.weight, c.unit,
    verdict <> 'Unanswered' AND target IS NOT NULL AND value IS NOT NULL AS measured,
    CASE WHEN direction = 'lower_better' THEN value <= target ELSE value >= target END AS clears FROM said s JOIN crit c USING (key)),
scored AS (SELECT *, CASE WHEN measured THEN clears ELSE verdict = 'Yes' END AS meets, COALESCE(stated, verdict) AS stated_text,
    CASE WHEN verdict = 'Unanswered' THEN 'none' WHEN ev LIKE '%certificate no%' OR ev LIKE '%audited%' THEN 'documented' WHEN value IS NOT NULL THEN 'quantified' ELSE 'asserted' END AS evidence FROM tested),
cards AS (SELECT vendor, floor(CAST(COALESCE(sum(CASE WHEN requirement <> 'Ignore' AND meets THEN weight END), 0) AS DOUBLE) / (SELECT sum(weight) FROM crit WHERE requirement <> 'Ignore') * 1e4 + 0.5) / 1e4 AS quality_score,
    count(*) FILTER (requirement = 'Must have' AND NOT meets) = 0 AS meets_requirements,
    COALESCE(string_agg(key, ',' ORDER BY key) FILTER (requirement = 'Must have' AND NOT meets), '') AS hard_failures,
    COALESCE(string_agg(key, ',' ORDER BY key) FILTER (verdict = 'Unanswered'), '') AS unanswered_criteria,
    count(value) AS disclosed_figures FROM scored GROUP BY 1)"""

UNPLACED = """unplaced AS (SELECT vendor, line_id, COALESCE(vendor_sku, '—') AS code, COALESCE(description, '—') AS description, quoted_value AS value, currency, COALESCE(unit_text, '') AS unit,
    CASE WHEN rfx_sku IS NULL THEN 'not on your list' ELSE concat('a second price for ', rfx_sku) END AS why FROM matched WHERE line_id NOT IN (SELECT line_id FROM placed))"""
GAPS = """seen AS (SELECT vendor, line_no FROM placed UNION ALL SELECT vendor, 0 FROM resp UNION ALL SELECT vendor, (SELECT count(*) + 1 FROM items) FROM resp),
steps AS (SELECT vendor, line_no, lead(line_no) OVER (PARTITION BY vendor ORDER BY line_no) AS nxt FROM seen),
gaps AS (SELECT vendor, line_no + 1 AS first_line, nxt - 1 AS last_line, nxt - line_no - 1 AS missing FROM steps WHERE nxt - line_no > 1)"""
FULL = """grid AS (SELECT i.sku AS rfx_sku, r.vendor, COALESCE(c.status, 'Not Quoted') AS status, c.canonical_value,
    COALESCE(c.reason, 'This line does not appear anywhere in the vendor''s response.') AS reason, c.missing_datum, c.original_value, c.original_currency, c.original_unit, c.flag_list, c.confidence, c.source_file, c.source_locator,
    c.source_snippet, c.currency, c.document_currency, c.unit_text, i.description, i.line_no, i.quantity, i.canonical_unit
    FROM items i CROSS JOIN resp r LEFT JOIN cell c ON c.rfx_sku = i.sku AND c.vendor = r.vendor)"""
CONF = """floor(greatest(0.05, least(0.99, (CASE WHEN confidence > 0 AND confidence <= 1 THEN confidence ELSE 0.8 END)
    * CASE WHEN source_snippet IS NULL THEN 0.82 ELSE 1.0 END * CASE WHEN source_file LIKE '%.jpg' THEN 0.93 ELSE 1.0 END
    * CASE WHEN unit_text IS NULL THEN 0.93 ELSE 1.0 END * CASE WHEN currency IS NULL AND document_currency IS NULL THEN 0.96 ELSE 1.0 END)) * 100.0 + 0.5) / 100.0"""
NOTES = """concat_ws('; ', CASE WHEN source_snippet IS NULL THEN 'no verbatim text was captured for this number' END, CASE WHEN source_file LIKE '%.jpg' THEN 'read from a photograph rather than a data file' END,
    CASE WHEN unit_text IS NULL THEN 'the supplier did not state what one price covers' END, CASE WHEN currency IS NULL AND document_currency IS NULL THEN 'the supplier never stated a currency' END)"""
BAND = "CASE WHEN conf >= 0.95 THEN 'very clear' WHEN conf >= 0.85 THEN 'clear' WHEN conf >= 0.7 THEN 'readable' ELSE 'hard to read' END"
SUMMARY = f"""{OFFERS}, reads AS (SELECT vendor, count(*) AS n, count(*) FILTER (rfx_sku IS NULL) AS extra_lines, count(currency) AS with_cur FROM matched GROUP BY 1),
prices AS (SELECT vendor, count(*) AS coverage_quoted, CAST(sum(comparable) AS BIGINT) AS comparable_lines FROM cell GROUP BY 1),
summary AS (SELECT r.*, COALESCE(p.coverage_quoted, 0) AS coverage_quoted, (SELECT count(*) FROM items) AS coverage_total, COALESCE(p.comparable_lines, 0) AS comparable_lines,
    COALESCE(d.extra_lines, 0) AS extra_lines, COALESCE(d.n - d.extra_lines - p.coverage_quoted, 0) AS second_prices,
    COALESCE(d.with_cur, 0) = 0 AND r.document_currency IS NULL AS currency_assumed FROM resp r LEFT JOIN reads d USING (vendor) LEFT JOIN prices p USING (vendor))"""
TOKENS = r"list_distinct(list_filter(list_concat(regexp_extract_all(lower({0}), '[a-z]+|[0-9]+'), list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+(?:-[a-z0-9]+)+'), lambda x: NOT regexp_matches(x, '(^|-)[0-9]+(-|$)')), list_transform(list_filter(generate_series(1, len(regexp_extract_all(lower({0}), '[a-z]+|[0-9]+')) - 1), lambda i: regexp_full_match(regexp_extract_all(lower({0}), '[a-z]+|[0-9]+')[i], '[0-9]+') AND regexp_full_match(regexp_extract_all(lower({0}), '[a-z]+|[0-9]+')[i + 1], '[a-z][a-z]+') AND NOT list_contains(noise, regexp_extract_all(lower({0}), '[a-z]+|[0-9]+')[i + 1])), lambda i: concat(regexp_extract_all(lower({0}), '[a-z]+|[0-9]+')[i], '-', regexp_extract_all(lower({0}), '[a-z]+|[0-9]+')[i + 1]))), lambda t: NOT list_contains(noise, t) AND (length(t) > 1 OR regexp_full_match(t, '[0-9]'))))"
NOISE = "(SELECT ['mm','cm','x','the','a','of','and','per','with','size','item','no','nos','pcs','pc','piece','pieces','each','unit','units','approx','approximately'] AS noise)"
SIZE = r"list_reverse_sort(list_filter([TRY_CAST(regexp_extract({0}, '([0-9]{{2,5}}) ?x ?([0-9]{{2,5}})', 1) AS INTEGER), TRY_CAST(regexp_extract({0}, '([0-9]{{2,5}}) ?x ?([0-9]{{2,5}})', 2) AS INTEGER)], lambda v: v IS NOT NULL))"
WORDING = "CASE l_suppkey % 3 WHEN 0 THEN {0} WHEN 1 THEN {1} ELSE {2} END".format(*I.SUPPLIER_WORDING.values())
TEXTS = f"texts AS (SELECT DISTINCT {WORDING} AS text FROM lineitem JOIN part ON l_partkey = p_partkey)"
VOCAB = f"""itok AS (SELECT sku, description, {TOKENS.format('description')} AS toks FROM items, {NOISE}),
vocab AS (SELECT token, count(*) AS lines FROM (SELECT unnest(toks) AS token FROM itok) GROUP BY 1 HAVING NOT regexp_full_match(token, '[0-9]+') AND count(*) <= greatest(1, (SELECT floor(count(*) * 0.5) FROM items))),
words AS (SELECT list(token) AS v FROM vocab),
cat AS (SELECT description, min(sku) AS sku, count(*) AS copies, any_value(toks) AS toks, list_filter(any_value(toks), lambda t: regexp_full_match(t, '[0-9]+')) AS figs,
    list_intersect(any_value(toks), any_value(v)) AS marks, {SIZE.format('description')} AS size FROM itok, words GROUP BY description),
txt AS (SELECT text, toks, list_filter(toks, lambda t: regexp_full_match(t, '[0-9]+')) AS figs, list_intersect(toks, v) AS marks, size FROM
    (SELECT text, {TOKENS.format('text')} AS toks, {SIZE.format('text')} AS size FROM texts, {NOISE}), words)"""
JAC = "(len(list_intersect(t.marks, c.marks)) / CAST(len(list_distinct(list_concat(t.marks, c.marks))) AS DOUBLE))"
OK_PAIR = f"(len(list_intersect(t.figs, c.figs)) = least(len(t.figs), len(c.figs)) AND (len(t.marks) = 0 OR len(c.marks) = 0 OR {JAC} >= 0.34))"

FIRM = I.FIRM.format(k="c_custkey")
INVITED = f"""inv0 AS (SELECT {I.REQUEST_OF} AS request_id, {FIRM} AS vendor, c_custkey AS vendor_ord, count(*) OVER (PARTITION BY {I.REQUEST_OF}) AS n,
    4 + CAST(greatest(0, ceil(2 * ln(count(*) OVER () / 256.0) / ln(16))) AS INT) AS digits FROM customer),
slug AS (SELECT *, substring(regexp_replace(upper(request_id), '[^A-Z0-9]', '', 'g'), 1, 10) AS rs, substring(regexp_replace(upper(vendor), '[^A-Z0-9]', '', 'g'), 1, 6) AS vs FROM inv0),
tok AS (SELECT *, concat('RFX-', rs, '-', vs, '-', substring(sha1(concat(rs, '|', lower(vendor), '|', CAST(n AS VARCHAR))), 1, digits)) AS token0,
    concat('RFX-', rs, '-', vs, '-', substring(sha1(concat(rs, '|', lower(vendor), '#1|', CAST(n AS VARCHAR))), 1, digits)) AS token1 FROM slug),
inv AS (SELECT request_id, vendor, vendor_ord, CASE WHEN row_number() OVER (PARTITION BY request_id, token0 ORDER BY vendor_ord) > 1 THEN token1 ELSE token0 END AS token FROM tok)"""
REPLIES = f"""{INVITED}, held AS (SELECT token, CASE WHEN count(*) = 1 THEN min(vendor) END AS holder FROM inv GROUP BY 1), rep AS (SELECT o_orderkey AS reply_id, o_orderkey % 5 AS kind, vendor, token, holder, (o_custkey + 1) IN (SELECT c_custkey FROM customer) AS other_known FROM orders JOIN inv ON o_custkey = vendor_ord JOIN held USING (token)),
att AS (SELECT reply_id, CASE WHEN kind = 0 THEN holder WHEN kind = 1 OR (kind = 4 AND NOT other_known) THEN vendor END AS vendor, CASE WHEN kind = 0 AND holder IS NOT NULL THEN upper(token) END AS token,
    CASE WHEN kind = 0 AND holder IS NOT NULL THEN 'token' WHEN kind = 1 OR (kind = 4 AND NOT other_known) THEN 'name' ELSE 'none' END AS basis FROM rep)"""
REQ = f"req AS (SELECT {cols(I.REQUEST_COLUMNS)} FROM orders), moment AS (SELECT *, TRY_CAST(nullif(starts_at, '') AS TIMESTAMP) AS s, TRY_CAST(ends_at AS TIMESTAMP) AS e FROM req), win AS (SELECT *, CAST(floor((epoch(e) - epoch(s)) / 86400) AS BIGINT) AS days FROM moment)"
DIRECTORY = f"""dir0 AS (SELECT concat(c_mktsegment, '-', CAST(c_nationkey AS VARCHAR)) AS category, {FIRM} AS vendor, c_custkey % 10 = 0 AS incumbent, {cols(I.DIRECTORY_SCORES)} FROM customer),
dir AS (SELECT *, floor((quality + COALESCE(delivery, 0) + commercial + responsiveness) / (3 + CASE WHEN delivery IS NULL THEN 0 ELSE 1 END) * 10 + 0.5) / 10.0 AS rating FROM dir0)"""
CATALOGUE = "catl AS (SELECT *, CAST(floor((line_no - 1) / 50) AS BIGINT) AS catalogue FROM items)"


def lot(seed: str, scope: str) -> str:
    return f"md5(concat('{seed}', '|', CAST({scope} AS VARCHAR), '|', sku))"


def size_of(seed: str, scope: str, low: str, span: str) -> str:
    digest = f"CAST(concat('0x', substring(md5(concat('{seed}', '|', CAST({scope} AS VARCHAR), '|size')), 1, 6)) AS BIGINT)"
    return f"({low} + {digest} % ({span}))"


EVENTS = f"ev0 AS (SELECT {cols(I.EVENT_COLUMNS)} FROM lineitem)"
# Played event by event: a list of the lines present, as the drafting tool holds it.
LINE = "struct_pack(code := {0}, description := {1}, quantity := {2}, unit := {3}, note := {4}, origin := {5})"
FOLD = f"""{EVENTS},
ev AS MATERIALIZED (SELECT request_id, event_ord, op, upper(sku) AS code, trim(description) AS description, quantity, unit, note, CASE WHEN origin LIKE 'sugg%' THEN 'suggested' ELSE 'buyer' END AS origin FROM ev0),
play AS (SELECT request_id, CAST(0 AS BIGINT) AS step, [{LINE.format("''", "''", "CAST(0 AS BIGINT)", "''", "''", "''")}][2:1] AS lines FROM ev GROUP BY request_id
    UNION ALL SELECT p.request_id, e.event_ord, CASE e.op
        WHEN 'add_line' THEN list_append(lines, {LINE.format(
            "list_filter([CASE WHEN k = 1 THEN e.code ELSE concat(e.code, '-', k) END FOR k IN range(1, len(lines) + 2)], lambda c: NOT list_contains([x.code FOR x IN lines], c))[1]",
            "e.description", "nullif(e.quantity, 0)", "e.unit", "COALESCE(e.note, '')", "e.origin")})
        WHEN 'remove_line' THEN list_filter(lines, lambda x: x.code <> e.code)
        ELSE list_transform(lines, lambda x: CASE WHEN x.code = e.code THEN {LINE.format(
            "x.code", "COALESCE(nullif(e.description, ''), x.description)", "COALESCE(nullif(e.quantity, 0), x.quantity)",
            "COALESCE(nullif(trim(e.unit), ''), x.unit)", "COALESCE(e.note, x.note)", "x.origin")} ELSE x END) END
    FROM play p JOIN ev e ON e.request_id = p.request_id AND e.event_ord = p.step + 1),
ended AS (SELECT request_id, unnest(arg_max(lines, step)) AS x FROM play GROUP BY request_id),
fold AS (SELECT request_id, x.code AS sku, x.description AS description, x.quantity AS quantity, CASE x.unit WHEN 'per box' THEN 'per box' WHEN 'per 100 sheets' THEN 'per 100 sheets' ELSE 'per unit' END AS canonical_unit,
    CASE x.unit WHEN 'per 100 sheets' THEN 'sheet' ELSE 'discrete' END AS unit_family, x.origin AS origin, x.note AS note FROM ended)"""
TERMTEXT = "tt AS (SELECT o_orderkey AS request_id, o_orderpriority AS p, o_orderstatus AS s, CAST(o_custkey AS VARCHAR) AS c FROM orders)"
TERMROWS = """tr AS (SELECT request_id, 1::BIGINT AS position, 'payment' AS kind, concat(p, chr(10), 'net of tax') AS text FROM tt UNION ALL SELECT request_id, 2, 'note 1', s FROM tt UNION ALL SELECT request_id, 3, 'payment (2)', c FROM tt)"""
LINES_OF = "string_split_regex(regexp_replace({0}, '(\\r\\n|\\n|\\r)$', ''), '\\r\\n|\\n|\\r')"


def consolidated_at(bar: int, rounds: int = 4) -> str:
    """The whole loop at a bar, one set of tables per round: the smallest below the bar goes, unless an item would be left without an offer."""
    win = "SELECT rfx_sku, arg_min(vendor, (price, vendor)) AS winner, arg_min(price, (price, vendor)) AS price, count(*) AS k FROM {0} GROUP BY 1"
    parts = [f"a{bar}_0 AS (SELECT * FROM offers)"]
    for r in range(rounds):
        parts.append(f"w{bar}_{r} AS ({win.format(f'a{bar}_{r}')})")
        parts.append(f"c{bar}_{r} AS (SELECT winner AS vendor, bool_or(k = 1) AS strands FROM w{bar}_{r} JOIN resp ON resp.vendor = winner GROUP BY winner, vendor_ord HAVING count(*) < {bar} ORDER BY count(*), vendor_ord LIMIT 1)")
        parts.append(f"a{bar}_{r + 1} AS (SELECT * FROM a{bar}_{r} WHERE vendor NOT IN (SELECT vendor FROM c{bar}_{r} WHERE NOT strands))")
    parts.append(f"w{bar}_{rounds} AS ({win.format(f'a{bar}_{rounds}')})")
    gone = " UNION ".join(f"SELECT vendor FROM c{bar}_{r} WHERE NOT strands" for r in range(rounds))
    spend = "CAST(sum(CAST(round(w.price * NULLIF(i.quantity, 0), 2) AS DECIMAL(28,2))) AS DOUBLE)"
    parts.append(f"g{bar} AS ({gone})")
    parts.append(f"f{bar} AS (SELECT (SELECT {spend} FROM w{bar}_0 w JOIN items i ON i.sku = w.rfx_sku) AS before, (SELECT {spend} FROM w{bar}_{rounds} w JOIN items i ON i.sku = w.rfx_sku) AS after, (SELECT count(*) FROM g{bar}) AS dropped, EXISTS (SELECT 1 FROM c{bar}_{rounds - 1} WHERE strands) AS stopped)")
    parts.append(f"""p{bar} AS (SELECT CAST({bar} AS BIGINT) AS min_lines, i.sku AS rfx_sku, z.winner, z.price, COALESCE(z.k, 0) AS contenders, CASE WHEN z.winner IS NULL THEN 'no_comparable' WHEN z.k = 1 THEN 'single_source' ELSE 'awarded' END AS status,
        CASE WHEN o.winner <> z.winner AND o.winner IN (SELECT vendor FROM g{bar}) THEN o.winner END AS reassigned_from,
        CASE WHEN dropped > 0 AND before <> 0 AND after <> 0 THEN round(after - before, 2) END AS consolidation_cost, dropped, stopped
        FROM items i LEFT JOIN w{bar}_{rounds} z ON z.rfx_sku = i.sku LEFT JOIN w{bar}_0 o ON o.rfx_sku = i.sku CROSS JOIN f{bar})""")
    return ", ".join(parts)


def dropped_suppliers(bar: int) -> str:
    """One vendor at a time, the list of those gone growing by one a step."""
    return f"""offered AS MATERIALIZED (SELECT rfx_sku, vendor, price FROM offers),
loop AS (SELECT 0 AS step, CAST([] AS VARCHAR[]) AS gone, false AS stopped, true AS more
    UNION ALL
    SELECT step + 1, CASE WHEN n.vendor IS NULL OR n.strands THEN gone ELSE list_append(gone, n.vendor) END, COALESCE(n.strands, false), n.vendor IS NOT NULL AND NOT n.strands
    FROM (SELECT * FROM loop WHERE more AND len(gone) + 1 < (SELECT count(*) FROM resp)) l LEFT JOIN
        (SELECT w.winner AS vendor, bool_or(w.k = 1) AS strands, count(*) AS wins, any_value(r.vendor_ord) AS vendor_ord FROM
            (SELECT rfx_sku, arg_min(vendor, (price, vendor)) AS winner, count(*) AS k FROM offered
                WHERE NOT list_contains((SELECT any_value(gone) FROM loop), vendor) GROUP BY rfx_sku) w
            JOIN resp r ON r.vendor = w.winner GROUP BY w.winner HAVING count(*) < {bar} QUALIFY row_number() OVER (ORDER BY count(*), any_value(r.vendor_ord)) = 1) n ON true),
ended AS (SELECT gone, stopped FROM loop ORDER BY step DESC LIMIT 1)"""


def statements() -> dict[str, str]:
    s, h = base("supplier"), base("house")
    snap = [I.SNAPSHOT.format(t="lineitem", w=w) for w in (I.BEFORE_ROWS, I.AFTER_ROWS)]
    houses = ["House AFRICA", "House AMERICA", "House ASIA", "House EUROPE", "House MIDDLE EAST"]
    pivot = lambda v, blank: ", ".join(f"COALESCE(max({v}) FILTER (vendor = '{x}'), {blank}) AS \"{x}\"" for x in houses)
    cleared = f"{s}, {ANSWERED}, {criteria()}, {SCORED.strip()}"
    label = f"""CASE WHEN status = 'Not Quoted' THEN 'not quoted' WHEN canonical_value IS NULL THEN CASE WHEN missing_datum IS NOT NULL THEN concat('no price — needs ', missing_datum) ELSE lower(status) END
        ELSE concat({money('canonical_value', "'INR'")}, CASE status WHEN 'Normalized' THEN ' ◆' WHEN 'Needs Review' THEN concat(' ▲ ', CASE list_filter(flag_list, lambda f: f IN ('unquantified_adder','conditional_price','subject_to_confirmation','cross_basis'))[1]
        WHEN 'unquantified_adder' THEN 'extra charge' WHEN 'conditional_price' THEN 'has a condition' WHEN 'subject_to_confirmation' THEN 'not firm' ELSE 'different basis' END) ELSE '' END) END"""
    exceptions = f"""{h}, {UNPLACED}, {FULL}, ex AS (SELECT CASE status WHEN 'Unresolved' THEN 0 WHEN 'Needs Review' THEN 1 ELSE 2 END AS severity, status, rfx_sku AS line, description AS item, vendor,
        CASE WHEN original_value IS NULL THEN '—' ELSE concat({money('original_value', "COALESCE(original_currency, 'INR')")}, CASE WHEN original_unit IS NULL THEN '' ELSE concat(' ', original_unit) END) END AS as_quoted,
        CASE WHEN original_value IS NULL THEN '—' ELSE concat(CAST(CAST(round(conf * 100) AS BIGINT) AS VARCHAR), '% · ', {BAND}) END AS read_clarity, reason AS why, COALESCE(missing_datum, '—') AS needed
        FROM (SELECT *, {CONF} AS conf FROM grid) WHERE status NOT IN ('Confirmed', 'Normalized')
        UNION ALL SELECT 3, CASE WHEN why LIKE 'a second%' THEN 'Second price' ELSE 'Not on your list' END, code, description, vendor,
        CASE WHEN value IS NULL THEN '—' ELSE concat(CASE currency WHEN '$' THEN concat(format('{{:,.2f}}', value), ' $') WHEN 'Rs.' THEN concat(format('{{:,.2f}}', value), ' Rs.') ELSE concat('₹', format('{{:,.2f}}', value)) END, CASE WHEN unit = '' THEN '' ELSE concat(' ', unit) END) END, '—',
        CASE WHEN why LIKE 'a second%' THEN concat('Read from their quote, but it is ', why, ' — only one price per item can go in the grid.') ELSE 'Read from their quote, but it does not match any item on your request.' END,
        CASE WHEN why LIKE 'a second%' THEN 'Confirm which of the two prices applies.' ELSE 'Add it to your request, or confirm they are quoting something you did not ask for.' END FROM unplaced)"""
    scard = lambda changes=None: f"WITH {ANSWERED}, {criteria(changes)}, {SCORED.strip()}"
    warn = f"""{s}, {SUMMARY}, tms AS (SELECT s_name AS vendor, CAST(s_suppkey % 4 AS DOUBLE) + 0.5 AS value FROM supplier),
        w AS (SELECT vendor, 'unplaced' AS kind, concat(CAST(extra_lines + second_prices AS VARCHAR), ' priced lines not placed') AS detail FROM summary WHERE extra_lines + second_prices > 0
        UNION ALL SELECT vendor, 'freight', CASE WHEN freight_included THEN 'includes delivery' WHEN NOT freight_included THEN 'charges delivery on top' ELSE 'does not say who pays delivery' END FROM summary
          WHERE (SELECT count(*) FROM summary WHERE freight_included) > 0 AND (SELECT count(*) FROM summary WHERE freight_included IS DISTINCT FROM true) > 0
        UNION ALL SELECT vendor, 'currency_assumed', 'never states a currency' FROM summary WHERE currency_assumed
        UNION ALL SELECT vendor, 'partial', concat('priced ', CAST(coverage_quoted AS VARCHAR), ' of ', CAST(coverage_total AS VARCHAR)) FROM summary WHERE coverage_quoted < coverage_total
        UNION ALL SELECT vendor, 'unsent_documents', concat('points to “', unresolved_reference, '”') FROM summary WHERE unresolved_reference IS NOT NULL
        UNION ALL SELECT vendor, 'discount', concat('offers ', CAST(value AS VARCHAR), '%') FROM tms)"""
    amount = lambda value: money(value, "'INR'")
    pair_score = f"floor((0.45 * (len(list_intersect(t.toks, c.toks)) / CAST(least(len(t.toks), len(c.toks)) AS DOUBLE)) + 0.30 * CASE WHEN len(t.size) < 2 OR len(c.size) < 2 THEN 0.5 WHEN t.size = c.size THEN 1.0 ELSE 0.0 END + 0.15 * CASE WHEN len(t.marks) > 0 AND len(c.marks) > 0 THEN {JAC} ELSE 0.5 END + 0.10 * (1.0 - levenshtein(lower(t.text), lower(c.description)) / CAST(greatest(length(t.text), length(c.description)) AS DOUBLE))) * 1000.0 + 0.5) / 1000.0"
    made = {
        "award_lines": f"{s}, {AWARD} SELECT rfx_sku, winner, price, extended, runner_up, runner_up_price, saving_per_unit, extended_saving, contenders, status FROM award",
        "normalized_quotes": f"{s} SELECT rfx_sku, vendor, original_value, original_currency, canonical_value, factor, rules, status, flags, comparable FROM cell",
        "refusals": f"{s} SELECT rfx_sku, vendor, reason, missing_datum FROM cell WHERE status = 'Unresolved'",
        "status_counts": f"{s} SELECT status, count(*) AS n, CAST(sum(comparable) AS BIGINT) AS comparable FROM cell GROUP BY 1",
        "fx_restamp": base("house", rate="CASE cur WHEN 'INR' THEN 1.0 WHEN 'USD' THEN 90.0 WHEN 'EUR' THEN 94.2 END", as_of="2026-02-01") + " SELECT vendor, status, count(*) AS n FROM cell GROUP BY 1, 2",
        "unit_parse": f"WITH {lines('supplier')} SELECT unit_text, count(*) AS lines, CASE WHEN unit_text IN ('per box', 'Nos', 'per 100 pcs') THEN 'discrete' WHEN unit_text = 'per roll' THEN 'roll' WHEN unit_text = 'per kg' THEN 'weight' END AS family, CASE unit_text WHEN 'per 100 pcs' THEN 100.0 WHEN '/ 1,000' THEN 1000.0 ELSE 1.0 END::DOUBLE AS pack, CASE unit_text WHEN 'per box' THEN 'box' WHEN 'Nos' THEN 'no' WHEN 'per 100 pcs' THEN 'pc' WHEN 'per roll' THEN 'roll' WHEN 'per kg' THEN 'kg' END AS noun FROM lines GROUP BY 1",
        "condition_flags": f"WITH {lines('supplier')} SELECT concat_ws(',', CASE WHEN condition_2 IS NOT NULL THEN 'unquantified_adder' END, CASE WHEN condition_1 IS NOT NULL OR notes <> '' THEN 'subject_to_confirmation' END, CASE WHEN condition_1 IS NOT NULL THEN 'conditional_price' END) AS flags, COALESCE(condition_3, '') AS unrecognised, count(*) AS n FROM lines GROUP BY 1, 2",
        "confidence_scores": f"{s} SELECT rfx_sku, vendor, {CONF} AS extraction_confidence, {NOTES} AS notes FROM cell",
        "sku_match": f"WITH {ITEMS}, {lines('supplier')}, {MATCHED.strip()} SELECT line_id, rfx_sku, match_basis, match_confidence FROM matched",
        "marker_vocabulary": f"WITH {ITEMS}, {TEXTS}, {VOCAB} SELECT token, lines FROM vocab",
        "dimension_signatures": f"WITH {ITEMS} SELECT array_to_string(list_transform({SIZE.format('description')}, lambda v: CAST(v AS VARCHAR)), 'x') AS size, count(*) AS items FROM items WHERE len({SIZE.format('description')}) = 2 GROUP BY 1",
        "dimension_match": f"""WITH {ITEMS}, {TEXTS}, {VOCAB}, hits AS (SELECT size, CAST(sum(copies) AS BIGINT) AS n FROM cat WHERE len(size) = 2 GROUP BY 1),
            one AS (SELECT t.text, c.sku AS rfx_sku, 0.88::DOUBLE AS match_confidence FROM txt t JOIN hits h ON h.size = t.size AND h.n = 1 JOIN cat c ON c.size = t.size WHERE {OK_PAIR}),
            many AS (SELECT t.text, min(c.sku) AS rfx_sku, 0.85::DOUBLE AS match_confidence FROM txt t JOIN hits h ON h.size = t.size AND h.n > 1 JOIN cat c ON c.size = t.size WHERE len(list_intersect(t.marks, c.marks)) > 0 GROUP BY 1 HAVING sum(c.copies) = 1)
            SELECT * FROM one UNION ALL SELECT * FROM many""",
        "description_match": f"""WITH {ITEMS}, {TEXTS}, {VOCAB}, pairs AS (SELECT t.text, c.sku, c.copies, c.description, {pair_score} AS score FROM txt t JOIN cat c ON {OK_PAIR}),
            top AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC, description) AS rn, lead(score) OVER (PARTITION BY text ORDER BY score DESC, description) AS nxt FROM pairs),
            best AS (SELECT text, sku, score, CASE WHEN copies > 1 THEN score ELSE nxt END AS nxt FROM top WHERE rn = 1)
            SELECT text, sku AS rfx_sku, score AS match_confidence FROM best WHERE CASE WHEN nxt IS NULL THEN score >= 0.58 ELSE (score >= 0.58 AND score - nxt >= 0.06) OR (score >= 0.52 AND score - nxt >= 0.25) END""",
        "duplicate_quotes": f"{s} SELECT line_id, vendor, rfx_sku, quoted_value FROM matched WHERE rfx_sku IS NOT NULL AND line_id NOT IN (SELECT line_id FROM placed)",
        "unplaced_lines": f"{s}, {UNPLACED} SELECT * FROM unplaced",
        "coverage_gaps": f"{s}, {GAPS} SELECT * FROM gaps",
        "full_grid": f"{h}, {FULL} SELECT rfx_sku, vendor, status, canonical_value, reason FROM grid",
        "vendor_summary": f"{cleared}, {SUMMARY} SELECT vendor, source_file, coverage_quoted, coverage_total, comparable_lines, extra_lines, second_prices, freight_included, payment_terms_days, lead_time_days, document_currency, currency_assumed, COALESCE(unresolved_reference, '') AS unresolved_references, overall_confidence, quality_score, meets_requirements, hard_failures, unanswered_criteria, disclosed_figures FROM summary JOIN cards USING (vendor)",
        "comparison_view": f"{cleared}, {SUMMARY} SELECT c.rfx_sku, i.description AS rfx_description, i.quantity AS rfx_quantity, c.vendor, c.canonical_value, c.canonical_value * i.quantity AS extended_value, c.status, k.quality_score, m.coverage_quoted FROM cell c JOIN items i ON i.sku = c.rfx_sku JOIN cards k ON k.vendor = c.vendor JOIN summary m ON m.vendor = c.vendor",
        "cheapest_by_line": f"{s}, {AWARD} SELECT rfx_sku, winner AS vendor, price FROM award WHERE winner IS NOT NULL",
        "cheapest_hiding_vendors": f"{h}, {OFFERS} SELECT rfx_sku, vendor, price FROM offers WHERE vendor <> 'House AFRICA' QUALIFY row_number() OVER (PARTITION BY rfx_sku ORDER BY price, vendor) = 1",
        "win_counts": f"{s}, {AWARD} SELECT winner AS vendor, count(*) AS cheapest_on FROM award WHERE winner IS NOT NULL GROUP BY 1",
        "winner_margin": f"""{h}, {AWARD}, m AS (SELECT rfx_sku, winner, price, runner_up_price - price AS gap, CASE WHEN runner_up_price IS NOT NULL THEN (runner_up_price - price) / runner_up_price END AS share, contenders FROM award),
            v AS (SELECT *, CASE WHEN winner IS NULL THEN 'no comparable price' WHEN contenders < 2 THEN 'only price' WHEN share < 0.005 THEN 'too close to call' ELSE 'cheaper' END AS verdict FROM m)
            SELECT rfx_sku, winner, price, gap, share, verdict, CASE verdict WHEN 'no comparable price' THEN verdict WHEN 'only price' THEN concat(winner, ' · only price') WHEN 'too close to call' THEN concat(winner, ' · ₹', format('{{:,.2f}}', gap), ' ahead — too close to call') ELSE concat(winner, ' · ₹', format('{{:,.2f}}', gap), ' (', printf('%.0f', share * 100), '%) cheaper') END AS label FROM v""",
        "price_matrix": f"{h}, {FULL} SELECT rfx_sku, line_no, {pivot('CASE WHEN status IN (' + chr(39) + 'Confirmed' + chr(39) + ',' + chr(39) + 'Normalized' + chr(39) + ') THEN canonical_value END', 'NULL')} FROM grid GROUP BY 1, 2",
        "status_grid": f"{h}, {FULL} SELECT rfx_sku, line_no, description, COALESCE(format('{{:,}}', quantity), '—') AS qty, replace(canonical_unit, 'per ', '') AS unit, {pivot('status', 'NULL')} FROM grid GROUP BY 1, 2, 3, 4, 5",
        "label_grid": f"{h}, {FULL}, lab AS (SELECT *, {label} AS l FROM grid) SELECT rfx_sku, line_no, description, COALESCE(format('{{:,}}', quantity), '—') AS qty, replace(canonical_unit, 'per ', '') AS unit, {pivot('l', 'NULL')} FROM lab GROUP BY 1, 2, 3, 4, 5",
        "headline_stats": f"{s}, n AS (SELECT (SELECT count(*) FROM resp) AS v, (SELECT count(*) FROM items) AS i) SELECT v AS suppliers, (SELECT count(DISTINCT CASE split_part(source_file, '.', 2) WHEN 'xlsx' THEN 'Spreadsheet' WHEN 'csv' THEN 'Spreadsheet' ELSE split_part(source_file, '.', 2) END) FROM resp) AS formats, CAST((SELECT sum(comparable) FROM cell) AS BIGINT) AS comparable_cells, v * i AS cells, v * i - CAST((SELECT count(*) FROM cell WHERE status IN ('Confirmed', 'Normalized')) AS BIGINT) AS need_attention, (SELECT count(DISTINCT rfx_sku) FROM cell WHERE comparable = 1) AS items_with_best_price, i AS items FROM n",
        "exceptions": f"{exceptions} SELECT * FROM ex",
        "exception_counts": f"{exceptions} SELECT status, count(*) AS n FROM ex GROUP BY 1",
        "review_legend": f"{s}, f AS (SELECT list_filter(flag_list, lambda f: f IN ('unquantified_adder','conditional_price','subject_to_confirmation','cross_basis'))[1] AS flag FROM cell WHERE status = 'Needs Review') SELECT flag, CASE flag WHEN 'unquantified_adder' THEN 'extra charge' WHEN 'conditional_price' THEN 'has a condition' WHEN 'subject_to_confirmation' THEN 'not firm' ELSE 'different basis' END AS tag, CASE flag WHEN 'unquantified_adder' THEN 'Price carries an unpriced extra charge' WHEN 'conditional_price' THEN 'Price depends on a condition the RFx cannot verify' WHEN 'subject_to_confirmation' THEN 'Vendor marked rates as not firm' ELSE 'Vendor''s unit family differs from the RFx line' END AS meaning, count(*) AS cells FROM f WHERE flag IS NOT NULL GROUP BY 1",
        "evidence": f"{s} SELECT rfx_sku, vendor, original_value, original_unit, canonical_value, factor, rules, status, source_snippet FROM cell WHERE rfx_sku = 'PTAA-123'",
        "audit_export": f"{h} SELECT c.rfx_sku, i.description, i.quantity AS rfx_quantity, c.vendor, c.original_value, c.canonical_value, c.rules, c.status FROM cell c JOIN items i ON i.sku = c.rfx_sku",
        "award_by_vendor": f"{h}, {AWARD} SELECT winner AS vendor, count(*) AS line_count, count(*) FILTER (status = 'single_source') AS single_source_lines, CAST(sum(CAST(extended AS DECIMAL(28,2))) AS DOUBLE) AS extended_total, count(*) / CAST((SELECT count(*) FROM award WHERE winner IS NOT NULL) AS DOUBLE) AS share_of_lines FROM award WHERE winner IS NOT NULL GROUP BY 1",
        "award_table": f"{h}, {AWARD} SELECT rfx_sku AS line, description AS item, winner AS suggested_supplier, {amount('price')} AS price, COALESCE(format('{{:,}}', quantity), '—') AS qty, CASE WHEN extended IS NULL THEN '—' ELSE {amount('extended')} END AS spend, COALESCE(runner_up, '— only one price') AS next_best, CASE WHEN extended_saving IS NOT NULL THEN {amount('extended_saving')} WHEN saving_per_unit <> 0 THEN concat({amount('saving_per_unit')}, ' per unit') ELSE '—' END AS saving, CASE WHEN status = 'awarded' THEN 'yes' ELSE 'no' END AS contested FROM award WHERE winner IS NOT NULL",
        "award_gaps": f"{h}, {AWARD} SELECT rfx_sku AS line, description AS item, 'No shortlisted supplier gave a price we can safely compare, so we cannot suggest anyone for this item.' AS why FROM award WHERE winner IS NULL",
        "common_basket": f"{h}, {AWARD}, {BASKET.strip()} SELECT rfx_sku FROM basket",
        "split_vs_single": f"{h}, {AWARD}, {BASKET.strip()} SELECT * FROM vsx",
        "plan_summary": f"{h}, {AWARD}, {BASKET.strip()}, {PLAN.strip()} SELECT * FROM plan",
        "split_analysis": f"{h}, {AWARD}, {BASKET.strip()}, {PLAN.strip()} SELECT total_extended, common_basket, split_on_common, best_single_vendor, best_single_total, saving_vs_single, saving_share FROM plan",
        "award_stats": f"{h}, {AWARD}, {BASKET.strip()}, {PLAN.strip()} SELECT supplier_count AS suppliers_recommended, concat(CAST(awarded_lines AS VARCHAR), '/', CAST(items AS VARCHAR)) AS items_recommended, {amount('total_extended')} AS estimated_spend, concat('₹', format('{{:,.0f}}', saving_vs_single), ' · ', printf('%.1f', saving_share * 100), '%') AS saving, concat('less than ', split_part(best_single_vendor, ' ', 1), ' alone, on the ', CAST(common_basket AS VARCHAR), ' items all of them priced') AS saving_caption FROM plan",
        "award_headline": f"{h}, {AWARD} SELECT winner AS vendor, count(*) AS line_count, concat('**', winner, '** for ', CAST(count(*) AS VARCHAR), CASE WHEN count(*) = 1 THEN ' item' ELSE ' items' END) AS part FROM award WHERE winner IS NOT NULL GROUP BY 1",
        "consolidated_award": f"{h}, {OFFERS}, {consolidated_at(300)} SELECT rfx_sku, winner, price, contenders, status, reassigned_from FROM p300",
        "consolidated_plan": f"{h}, {OFFERS}, {consolidated_at(3)}, {consolidated_at(300)} SELECT * FROM p3 UNION ALL SELECT * FROM p300",
        "award_caveats": f"{h}, {AWARD}, k AS (SELECT 2 AS position, 'uncontested' AS kind, count(*) FILTER (status = 'single_source') AS n FROM award UNION ALL SELECT 3, 'unawardable', count(*) FILTER (status = 'no_comparable') FROM award UNION ALL SELECT 5, 'freight_mixed', count(DISTINCT freight_included) + max(CASE WHEN freight_included IS NULL THEN 1 ELSE 0 END) FROM resp UNION ALL SELECT 7, 'quantities_missing', CASE WHEN count(extended) < count(winner) THEN count(winner) ELSE 0 END FROM award) SELECT position, kind, CAST(n AS BIGINT) AS n FROM k WHERE n > 0",
        "shortlist_by_quality": f"{scard()} SELECT vendor, quality_score, meets_requirements, meets_requirements AND quality_score >= 0.6 AS eligible FROM cards",
        "scored_answers": f"{scard()} SELECT vendor, key, verdict, stated_text, value, meets, evidence, CASE WHEN meets THEN 1.0 ELSE 0.0 END::DOUBLE AS score, CASE WHEN verdict = 'Unanswered' THEN 'Did not address this question at all.' WHEN measured THEN concat('Stated ', stated_text, ', which ', CASE WHEN meets THEN 'meets' ELSE 'does not meet' END, ' the target of ', CASE WHEN direction = 'lower_better' THEN 'less than ' ELSE 'greater than ' END, format('{{:,}}', CAST(target AS BIGINT)), CASE WHEN unit = '%' THEN '%' ELSE concat(' ', trim(unit)) END, '.') WHEN verdict = 'Yes' THEN 'Answered Yes.' WHEN verdict = 'Partial' THEN 'Answered only in part.' WHEN note IS NULL THEN 'Answered No.' ELSE concat('Answered No — ', note) END AS explanation FROM scored",
        "scorecards": f"{scard()} SELECT * FROM cards",
        "rescored": f"{scard({'iso': ('Scored', None, 3.0), 'capacity': ('Must have', 14000.0, 1.0)})} SELECT * FROM cards",
        "scorecard_report": f"{scard()} SELECT vendor, printf('%.0f', quality_score * 100) AS quality, concat(CAST(disclosed_figures AS VARCHAR), '/5') AS figures_disclosed, CASE WHEN unanswered_criteria = '' THEN 0 ELSE CAST(len(string_split(unanswered_criteria, ',')) AS BIGINT) END AS not_answered, CASE WHEN hard_failures = '' THEN 'no' ELSE replace(hard_failures, ',', ', ') END AS misses, CASE WHEN quality_score * 100 >= 80 THEN 'good' WHEN quality_score * 100 >= 55 THEN 'mid' ELSE 'poor' END AS band FROM cards",
        "questionnaire": f"{scard()} SELECT vendor, key AS criterion_key, verdict, value AS numeric_value, target, CAST(meets AS INTEGER) AS meets, CASE WHEN meets THEN 1.0 ELSE 0.0 END::DOUBLE AS score, requirement FROM scored",
        "question_parse": f"WITH {ANSWERED} SELECT question, count(*) AS asked, {reading()}, {SLUG.format('question')} AS slug FROM asked GROUP BY question",
        "question_clusters": f"WITH {ANSWERED}, {CLUSTERS} SELECT question, root, asked FROM clusters",
        "asked_questions": f"WITH {ANSWERED}, log AS (SELECT vendor_ord % 10 AS request_id, vendor_ord * 10 + question_ord AS ord, key, question FROM asked), f AS (SELECT request_id, arg_min(question, ord) AS question FROM log GROUP BY request_id, key) SELECT request_id, question, {SLUG.format('question')} AS key, {READING['threshold']} AS threshold FROM f",
        "question_log_fold": f"""WITH {ANSWERED}, log AS (SELECT vendor_ord % 10 AS request_id, vendor_ord * 10 + question_ord AS event_ord, key AS same, question, (vendor_ord + question_ord) % 4 = 0 AS removes, vendor_ord % 3 = 0 AS must, vendor_ord % 2 AS w FROM asked),
            gone AS (SELECT request_id, same, max(event_ord) AS last FROM log WHERE removes GROUP BY 1, 2),
            f AS (SELECT l.* FROM log l LEFT JOIN gone g USING (request_id, same) WHERE NOT removes AND event_ord > COALESCE(last, -1) QUALIFY row_number() OVER (PARTITION BY request_id, same ORDER BY event_ord) = 1)
            SELECT request_id, event_ord, question, {SLUG.format('question')} AS key, {reading()}, CASE WHEN must THEN 'Must have' ELSE 'Scored' END AS requirement, 1.0::DOUBLE AS weight FROM f""",
        "derived_criteria": f"""WITH {ITEMS}, {ANSWERED}, {CLUSTERS}, rd AS (SELECT *, {reading()} FROM clusters),
            g AS (SELECT root, min(rank) AS rank, count(*) AS variants, arg_max(question, (spelled, length(question), -rank[1], -rank[2])) AS question, arg_min(kind, rank) AS kind,
                arg_min(struct_pack(d := direction, t := threshold, u := unit), rank) AS own, arg_min(struct_pack(d := direction, t := threshold, u := unit), rank) FILTER (threshold IS NOT NULL) AS stated FROM rd GROUP BY root),
            p AS (SELECT *, row_number() OVER (ORDER BY rank) AS position, {SLUG.format('root')} AS slug, CASE WHEN own.t IS NOT NULL OR stated IS NULL THEN own ELSE stated END AS target FROM g),
            m AS (SELECT CAST(sum(nullif(quantity, 0)) AS BIGINT) / 12.0 * 1.5 AS aim FROM items), st AS (SELECT aim, CASE WHEN aim < 20000 THEN 1000.0 ELSE 5000.0 END AS step FROM m)
            SELECT CASE WHEN position = min(position) OVER (PARTITION BY slug) THEN slug ELSE concat(slug, '_', CAST(position AS VARCHAR)) END AS key, position, question, root, variants, kind, target.d AS direction, target.t AS threshold, target.u AS unit,
            'Scored' AS requirement, 1.0::DOUBLE AS weight, CASE WHEN trim(target.u) = 'units/month' THEN CAST(round_even(aim / step, 0) * step AS DOUBLE) END AS suggested_threshold FROM p CROSS JOIN st""",
        "unit_vote": f"WITH {lines('supplier')}, g AS (SELECT CASE WHEN vendor_sku IS NOT NULL THEN {I.sku('k')} END AS sku, unit_text, vendor_ord, line_ord, line_id FROM (SELECT *, CAST(split_part(line_id, '-', 3) AS BIGINT) AS k FROM lines)), u AS (SELECT sku, CASE unit_text WHEN 'per box' THEN 'box' WHEN 'Nos' THEN 'no' WHEN 'per 100 pcs' THEN 'pc' WHEN 'per roll' THEN 'roll' END AS noun, CASE WHEN unit_text IN ('per box', 'Nos', 'per 100 pcs') THEN 'discrete' WHEN unit_text = 'per roll' THEN 'roll' END AS fam, vendor_ord, line_ord, line_id FROM g WHERE sku IS NOT NULL), f AS (SELECT sku, fam FROM (SELECT sku, fam, count(*) AS n, min((vendor_ord, line_ord, line_id)) AS first FROM u WHERE fam IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY sku ORDER BY n DESC, first) = 1), nn AS (SELECT sku, noun FROM (SELECT u.sku, noun, count(*) AS n, min((vendor_ord, line_ord, line_id)) AS first FROM u JOIN f ON f.sku = u.sku AND f.fam = u.fam GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY sku ORDER BY n DESC, first) = 1) SELECT s.sku, CASE WHEN f.fam IS NULL THEN 'per unit' WHEN nn.noun IN ('no', 'pc') THEN 'per unit' ELSE concat('per ', nn.noun) END AS canonical_unit, COALESCE(f.fam, 'discrete') AS unit_family FROM (SELECT DISTINCT sku FROM u) s LEFT JOIN f USING (sku) LEFT JOIN nn USING (sku)",
        "quantity_vote": f"WITH {lines('supplier')}, g AS (SELECT {I.sku('k')} AS sku, CAST(quantity AS BIGINT) AS quantity, vendor_ord, line_ord, line_id FROM (SELECT *, CAST(split_part(line_id, '-', 3) AS BIGINT) AS k FROM lines) WHERE vendor_sku IS NOT NULL) SELECT sku, quantity FROM (SELECT sku, quantity, count(*) AS n, min((vendor_ord, line_ord, line_id)) AS first FROM g GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY sku ORDER BY n DESC, first) = 1",
        "description_vote": f"WITH d AS (SELECT {I.sku('l_partkey')} AS sku, {WORDING} AS description, s_name AS vendor, l_orderkey * 10 + l_linenumber AS line_ord FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey) SELECT sku, description FROM (SELECT sku, description, count(*) AS n, min((line_ord, vendor)) AS first FROM d GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY sku ORDER BY n DESC, length(description) DESC, first) = 1",
        "currency_vote": f"WITH {lines('supplier')}, {vendors('supplier')}, c AS (SELECT upper(currency) AS c, vendor_ord, line_ord FROM lines WHERE currency IS NOT NULL UNION ALL SELECT upper(document_currency), vendor_ord, 0 FROM resp WHERE document_currency IS NOT NULL) SELECT (SELECT c FROM (SELECT c, count(*) AS n, min((vendor_ord, line_ord)) AS f FROM c GROUP BY 1) ORDER BY n DESC, f LIMIT 1) AS currency, (SELECT count(*) FROM c) = 0 AS currency_inferred",
        "basket_monthly": f"WITH {ITEMS} SELECT CAST(sum(nullif(quantity, 0)) AS BIGINT) / 12.0::DOUBLE AS units_per_month, count(nullif(quantity, 0)) AS items_with_quantity FROM items",
        "located_lines": f"WITH l AS (SELECT doc_id, unnest({LINES_OF.format('text')}) AS line, generate_subscripts({LINES_OF.format('text')}, 1) AS line_no FROM documents WHERE length(text) > 0) SELECT doc_id, line_no, concat('[line ', CAST(line_no AS VARCHAR), '] ', line) AS located FROM l",
        "located_rows": f"WITH l AS (SELECT conv_id, unnest({LINES_OF.format('text')}) AS line, generate_subscripts({LINES_OF.format('text')}, 1) AS line_no FROM conversations WHERE length(text) > 0) SELECT conv_id, count(*) AS rows, max(line_no) AS last_row FROM l WHERE trim(line) <> '' GROUP BY 1",
        "html_text": "WITH b AS (SELECT page_id, regexp_replace(regexp_replace(html, '<br\\s*/?>', chr(10), 'g'), '<[^>]+>', ' ', 'g') AS text FROM pages), l AS (SELECT page_id, unnest(" + LINES_OF.format("text") + ") AS line, generate_subscripts(" + LINES_OF.format("text") + ", 1) AS line_no FROM b WHERE length(text) > 0) SELECT page_id, line_no, concat('[line ', CAST(line_no AS VARCHAR), '] ', line) AS located FROM l",
        "text_triage": "WITH m AS (SELECT doc_id, text, 2 * (length(text) - length(replace(text, '�', ''))) + length(text) - length(replace(text, '■', '')) + length(text) - length(replace(text, '□', '')) AS marks FROM documents), r AS (SELECT doc_id, CASE WHEN regexp_full_match(text, '\\s*') THEN 'no extractable text layer (likely a scan)' WHEN marks >= 3 THEN concat(CAST(marks AS VARCHAR), ' unmapped glyphs in the text layer (currency symbols are probably being lost)') WHEN marks > 0 AND regexp_matches(text, '[0-9]') AND NOT regexp_matches(text, '(?i)[₹$€£]|INR|USD|EUR|GBP') THEN 'prices present but no currency marker survived extraction' END AS reason FROM m) SELECT doc_id, reason IS NOT NULL AS rejected, COALESCE(reason, '') AS reason FROM r",
        "document_limits": "SELECT doc_id, length(coalesce(text, '')) > 20000 AS over_limit, CAST(greatest(1, ceil(length(coalesce(text, '')) / 20000.0)) AS INTEGER) AS parts, CAST(length(coalesce(text, '')) AS BIGINT) AS chars FROM documents",
        "decoded_text": "SELECT doc_id, md5(text) AS digest FROM documents",
        "file_formats": f"WITH {vendors('supplier')}, x AS (SELECT split_part(source_file, '.', 2) AS extension FROM resp) SELECT extension, CASE extension WHEN 'xlsx' THEN 'spreadsheet' WHEN 'pdf' THEN 'pdf' WHEN 'eml' THEN 'email' WHEN 'csv' THEN 'text' WHEN 'jpg' THEN 'image' ELSE 'word' END AS reader, CASE extension WHEN 'xlsx' THEN 'Spreadsheet' WHEN 'pdf' THEN 'PDF document' WHEN 'eml' THEN 'Email' WHEN 'csv' THEN 'Spreadsheet' WHEN 'jpg' THEN 'Photograph' ELSE 'Word document' END AS format, count(*) AS files FROM x GROUP BY 1",
        "file_outcomes": "WITH q AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1), d AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS file, c_custkey % 17 <> 0 AS has, c_custkey % 23 = 0 AS bad, n FROM customer LEFT JOIN q ON k = c_custkey) SELECT file, 'text' AS reader, has AND NOT bad AS ok, CASE WHEN has AND NOT bad THEN COALESCE(n, 0) ELSE 0 END AS lines_found, has AND NOT bad AND n IS NULL AS supporting, CASE WHEN NOT has THEN 'No readable content could be extracted from this file.' WHEN bad THEN 'unreadable' ELSE '' END AS error FROM d",
        "blanket_conditions": f"WITH {lines('supplier')}, n AS (SELECT vendor, count(*) AS lines FROM lines GROUP BY 1), c AS (SELECT vendor, lower(unnest(list_distinct(list_filter([condition_1, condition_2, condition_3], lambda x: x IS NOT NULL)))) AS condition FROM lines) SELECT vendor, condition, count(*) AS used_on, any_value(n.lines) AS lines FROM c JOIN n USING (vendor) GROUP BY 1, 2 HAVING any_value(n.lines) >= 5 AND count(*) >= 0.6 * any_value(n.lines)",
        "invite_tokens": f"WITH {INVITED} SELECT request_id, vendor, token, concat('Request for quotation — Annual contract [', token, ']') AS subject, concat(replace(request_id, '/', '_'), '.pdf') AS attachment_name FROM inv",
        "reply_attribution": f"WITH {REPLIES} SELECT * FROM att",
        "credited_replies": f"""WITH {REPLIES}, rd AS (SELECT o_orderkey AS reply_id, CASE o_orderkey % 3 WHEN 0 THEN vendor WHEN 1 THEN 'Letterhead unread' END AS seen FROM orders JOIN inv ON o_custkey = vendor_ord)
            SELECT reply_id, COALESCE(vendor, seen) AS vendor, basis AS identified_by, token, CASE WHEN vendor IS NULL OR vendor IS NOT DISTINCT FROM seen THEN NULL
            WHEN basis = 'token' THEN concat('Credited to ', vendor, ': the reply quotes the reference of that invitation.')
            ELSE concat('Credited to ', vendor, ' by name alone; no reference was quoted, so this needs a second look.') END AS attribution_note FROM att JOIN rd USING (reply_id)""",
        "invitation_status": f"WITH {REPLIES}, st AS (SELECT CASE WHEN vendor IN (SELECT vendor FROM att WHERE vendor IS NOT NULL) THEN 'responded' WHEN vendor_ord % 5 = 0 THEN 'not sent' WHEN vendor_ord % 7 <> 0 THEN 'sent' ELSE 'failed' END AS status FROM inv) SELECT status, count(*) AS n FROM st GROUP BY 1",
        "request_validation": f"WITH {REQ} SELECT request_id, 1 AS position, 'RFQ start date and time' AS issue FROM win WHERE s IS NULL UNION ALL SELECT request_id, 2, 'RFQ end date and time' FROM win WHERE e IS NULL UNION ALL SELECT request_id, 3, 'Vendor category' FROM win WHERE trim(vendor_category) = '' UNION ALL SELECT request_id, 4, 'A closing time later than the opening time' FROM win WHERE trim(vendor_category) <> '' AND days < 0 UNION ALL SELECT request_id, 5, 'At least one supplier' FROM win WHERE supplier_count < 1",
        "quoting_windows": f"WITH {REQ} SELECT request_id, days, CASE WHEN days < 0 THEN 'closes before it opens' WHEN days < 5 THEN 'short window' WHEN days IS NOT NULL THEN 'ok' END AS check, CASE WHEN s IS NOT NULL THEN strftime(s, '%-d %b %Y, %H:%M') ELSE starts_at END AS opens FROM win",
        "rate_staleness": "SELECT CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-06-01') > 30 THEN 'stale' WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-06-01') < 0 THEN 'forward' ELSE 'current' END AS check, count(*) AS n FROM orders GROUP BY 1",
        "vendor_shortlist": f"WITH {DIRECTORY}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY rating DESC, incumbent DESC, vendor) AS rn, count(*) OVER (PARTITION BY category) AS approved, count(*) FILTER (rating >= 7) OVER (PARTITION BY category) AS clearing FROM dir) SELECT category, vendor, rating, approved, clearing FROM r WHERE CASE WHEN clearing >= 2 THEN rating >= 7 ELSE rn <= 2 END",
        "vendor_ratings": f"""WITH {DIRECTORY}, sc AS (SELECT *, list_filter([quality, delivery, commercial, responsiveness], lambda x: x IS NOT NULL) AS have FROM dir),
            ex AS (SELECT *, list_max(have) AS hi, list_min(have) AS lo FROM sc)
            SELECT vendor, rating, concat(CASE WHEN incumbent THEN 'Incumbent. ' ELSE '' END, CASE WHEN hi - lo < 1 THEN concat('even across the board at ', printf('%.1f', rating)) ELSE concat('strongest on ',
            CASE WHEN quality = hi THEN 'quality' WHEN delivery = hi THEN 'delivery' WHEN commercial = hi THEN 'commercial' ELSE 'responsiveness' END, ' (', regexp_replace(CAST(hi AS VARCHAR), '\\.0$', ''), '), weakest on ',
            CASE WHEN quality = lo THEN 'quality' WHEN delivery = lo THEN 'delivery' WHEN commercial = lo THEN 'commercial' ELSE 'responsiveness' END, ' (', regexp_replace(CAST(lo AS VARCHAR), '\\.0$', ''), ')') END, '.') AS why FROM ex""",
        "demoted_conditions": f"WITH {lines('supplier')}, k AS (SELECT vendor, CAST(sum(CASE WHEN condition_1 IS NULL THEN 0 ELSE 1 END + CASE WHEN condition_2 IS NULL THEN 0 ELSE 1 END + CASE WHEN condition_3 IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS n, count(condition_3) AS c3, count(*) AS lines FROM lines GROUP BY 1) SELECT vendor, CASE WHEN c3 >= 0.6 * lines THEN n - c3 ELSE n END AS conditions_left, CASE WHEN c3 >= 0.6 * lines THEN 4 ELSE 3 END::BIGINT AS terms FROM k",
        "responses_flat": f"WITH {lines('supplier')} SELECT vendor, unit_text, currency, count(*) AS lines, count(quoted_value) AS priced, CAST(sum(CASE WHEN condition_1 IS NULL THEN 0 ELSE 1 END + CASE WHEN condition_2 IS NULL THEN 0 ELSE 1 END + CASE WHEN condition_3 IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS conditions FROM lines GROUP BY 1, 2, 3",
        "replenishment_draw": f"WITH {ITEMS}, {CATALOGUE}, r AS (SELECT *, row_number() OVER (PARTITION BY catalogue ORDER BY {lot('day-1', 'catalogue')}, sku) AS rn FROM catl) SELECT catalogue, sku, line_no, 'suggested' AS origin FROM r WHERE rn <= {size_of('day-1', 'catalogue', '10', '6')}",
        "annual_list": f"WITH {ITEMS}, {CATALOGUE}, core AS (SELECT catalogue, sku FROM catl WHERE line_no % 50 <= 28), k AS (SELECT catalogue, count(*) AS core FROM core GROUP BY 1), r AS (SELECT c.*, k.core, row_number() OVER (PARTITION BY c.catalogue ORDER BY {lot('2026', 'c.catalogue')}, sku) AS rn FROM catl c JOIN k ON k.catalogue = c.catalogue WHERE line_no % 50 > 28) SELECT catalogue, sku, 'buyer' AS origin FROM core UNION ALL SELECT catalogue, sku, 'buyer' FROM r WHERE rn <= {size_of('2026', 'catalogue', 'greatest(30, core)', 'greatest(35, core) - greatest(30, core) + 1')} - core",
        "consolidated_suppliers": f"{s.replace('WITH ', 'WITH RECURSIVE ', 1)}, {OFFERS}, {dropped_suppliers(15)} SELECT unnest(gone) AS vendor, CAST(unnest(range(1, len(gone) + 1)) AS BIGINT) AS place, CAST(len(gone) AS BIGINT) AS dropped, stopped FROM ended",
        "placeholder_codes": """WITH g AS (SELECT c_name, row_number() OVER (ORDER BY c_nationkey, c_custkey, c_name) AS k FROM customer),
            free AS (SELECT n, row_number() OVER (ORDER BY n) AS k FROM (SELECT unnest(range(1, (SELECT count(*) FROM customer) + (SELECT count(*) FROM part) + 1)) AS n) WHERE n NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0))
            SELECT c_name AS text, concat('ITEM-', CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END) AS sku FROM g JOIN free USING (k)""",
        "edit_log_fold": f"WITH RECURSIVE {FOLD} SELECT * FROM fold",
        "sendable_lines": f"WITH RECURSIVE {FOLD} SELECT request_id, count(*) AS lines FROM fold WHERE origin <> 'suggested' GROUP BY 1",
        "table_diff": f"WITH b AS ({snap[0]}), a AS ({snap[1]}) SELECT COALESCE(b.request_id, a.request_id) AS request_id, COALESCE(b.line_no, a.line_no) AS line_no, CASE WHEN b.request_id IS NULL THEN 'added' WHEN a.request_id IS NULL THEN 'removed' WHEN b.item = a.item AND b.quantity = a.quantity THEN 'unchanged' ELSE 'changed' END AS change FROM b FULL JOIN a ON a.request_id = b.request_id AND a.line_no = b.line_no",
        "merged_edits": f"WITH b AS ({snap[0]}), a AS ({snap[1]}) SELECT a.request_id, concat('L-', CAST(a.line_no AS VARCHAR)) AS sku, concat('item ', CAST(a.item AS VARCHAR)) AS description, a.quantity, CASE WHEN b.request_id IS NULL THEN 'buyer' WHEN b.item % 2 <> 0 THEN 'document' WHEN a.item = b.item AND a.quantity = b.quantity THEN 'suggested' ELSE 'buyer' END AS origin FROM a LEFT JOIN b ON a.request_id = b.request_id AND a.line_no = b.line_no",
        "terms_parse": f"WITH {TERMTEXT}, {TERMROWS} SELECT * FROM tr",
        "unique_item_codes": "WITH l AS (SELECT l_orderkey AS request_id, l_linenumber, concat('C-', CAST(min(l_partkey) % 2 AS VARCHAR)) AS c FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY request_id, c ORDER BY l_linenumber) AS rn FROM l) SELECT request_id, l_linenumber, CASE WHEN rn = 1 THEN c ELSE concat(c, '-', CAST(rn AS VARCHAR)) END AS sku FROM r",
        "completed_terms": f"WITH {TERMTEXT}, {TERMROWS}, a AS (SELECT request_id, kind FROM tr UNION ALL SELECT request_id, 'tax' FROM tt) SELECT kind, count(*) AS n FROM a GROUP BY 1",
        "extra_invitees": f"WITH {INVITED} SELECT request_id, vendor FROM inv WHERE vendor_ord % 3 = 0 OR vendor_ord % 2 = 0",
        "warnings": f"{warn} SELECT vendor, kind, detail FROM w",
        "warning_counts": f"{warn} SELECT kind, count(*) AS mentions, count(DISTINCT vendor) AS vendors FROM w GROUP BY 1",
        "vendor_report": f"{s}, {SUMMARY} SELECT vendor, source_file AS document, CASE split_part(source_file, '.', 2) WHEN 'xlsx' THEN 'Spreadsheet' WHEN 'pdf' THEN 'PDF document' WHEN 'eml' THEN 'Email' WHEN 'csv' THEN 'Spreadsheet' WHEN 'jpg' THEN 'Photograph' ELSE 'Word document' END AS format, concat(CAST(coverage_quoted AS VARCHAR), '/', CAST(coverage_total AS VARCHAR)) AS lines_quoted, CAST(floor(100.0 * coverage_quoted / coverage_total + 0.5) AS BIGINT) AS coverage_pct, CAST(floor(100.0 * comparable_lines / coverage_total + 0.5) AS BIGINT) AS comparable_pct, CASE WHEN freight_included THEN 'Included' WHEN NOT freight_included THEN 'Extra' ELSE 'Not stated' END AS freight, concat(CAST(payment_terms_days AS VARCHAR), ' days') AS payment, CASE WHEN lead_time_days IS NULL THEN 'not stated' ELSE concat(CAST(lead_time_days AS VARCHAR), ' days') END AS lead_time, COALESCE(document_currency, 'not stated') AS currency, concat(printf('%.0f', overall_confidence * 100), '%') AS read_clarity FROM summary",
        "terms_report": "SELECT s_name AS supplier, k AS about, CASE k WHEN 'Freight' THEN CASE WHEN s_nationkey % 3 = 0 THEN 'Delivered price' ELSE 'Freight extra' END WHEN 'Payment' THEN concat(CAST(30 + 15 * (s_suppkey % 3) AS VARCHAR), ' days from invoice') ELSE 'Slab rates on annual offtake' END AS in_their_words, CASE WHEN k = 'Discount' THEN 'confirmed annual volumes' ELSE '—' END AS only_if FROM supplier, (SELECT unnest(['Freight', 'Payment', 'Discount']) AS k)",
        "cheapest_cleared": f"{cleared}, {OFFERS} SELECT rfx_sku, vendor, price FROM offers JOIN cards USING (vendor) WHERE meets_requirements AND quality_score >= 0.6 QUALIFY row_number() OVER (PARTITION BY rfx_sku ORDER BY price, vendor) = 1",
        "price_disagreements": f"{s}, o AS (SELECT rfx_sku, vendor, canonical_value AS p, pack > 1 OR cur <> 'INR' OR famless AS conv FROM cell WHERE comparable = 1 AND canonical_value > 0), g AS (SELECT rfx_sku, count(*) AS offers, arg_min(p, (p, vendor)) AS low_price, arg_max(p, (p, vendor)) AS high_price, arg_min(conv, (p, vendor)) AS lc, arg_max(conv, (p, vendor)) AS hc FROM o GROUP BY 1) SELECT rfx_sku, offers, low_price, high_price, {R4.format('high_price / low_price')} AS spread, CASE WHEN lc OR hc THEN 'check units' ELSE 'price' END AS cause FROM g WHERE offers > 1",
        "what_to_ask": f"{s} SELECT vendor, CASE WHEN heavy THEN 'unit weight' WHEN rateless THEN 'a convertible currency' WHEN status = 'Unresolved' THEN 'a stated price' WHEN crossed THEN 'a price on the requested unit' ELSE 'confirmation of conditions' END AS ask, count(*) AS lines FROM cell WHERE status IN ('Unresolved', 'Needs Review') GROUP BY 1, 2",
        "effect_of_quality": f"{cleared}, o AS (SELECT c.rfx_sku, c.vendor, c.canonical_value AS p, meets_requirements AND quality_score >= 0.6 AS ok FROM cell c JOIN cards USING (vendor) WHERE comparable = 1), w AS (SELECT 'with quality bar' AS scenario, rfx_sku, min(p) AS p FROM o WHERE ok GROUP BY 2 UNION ALL SELECT 'ignoring quality', rfx_sku, min(p) FROM o GROUP BY 2) SELECT scenario, count(*) AS awarded_lines, CAST(sum(CAST({R2.format('p * nullif(quantity, 0)')} AS DECIMAL(28,2))) AS DOUBLE) AS total_extended FROM w JOIN items ON sku = rfx_sku GROUP BY 1",
        "guarded_sql": f"{h} SELECT vendor, canonical_unit, count(*) AS n, min(canonical_value) AS lowest FROM cell WHERE comparable = 1 AND canonical_value > 1 GROUP BY 1, 2",
    }
    ask = "concat('Is part ', CAST(item % 50 AS VARCHAR), ' in stock?')"
    level, weight = "CASE WHEN item % 3 = 0 THEN 'Must have' ELSE 'Scored' END", "CASE WHEN item % 4 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE"
    place = "row_number() OVER (PARTITION BY request_id ORDER BY serial) AS place"
    made["merged_questions"] = f"""WITH b AS ({snap[0]}), a AS ({snap[1]}),
        old AS (SELECT request_id, line_no AS serial, {ask} AS question, concat('part_', CAST(item % 50 AS VARCHAR)) AS key, CAST(quantity AS DOUBLE) AS threshold, {level} AS requirement, {weight} AS weight FROM b),
        q AS (SELECT request_id, line_no AS serial, CASE WHEN item % 5 = 0 THEN concat('Corrected: ', {ask}) ELSE {ask} END AS question, CAST(quantity AS DOUBLE) AS threshold, {level} AS requirement, {weight} AS weight, item FROM a),
        alike AS (SELECT request_id, question, arg_min(key, serial) AS key FROM old GROUP BY 1, 2),
        m0 AS (SELECT q.*, COALESCE(o.key, l.key, concat(CASE WHEN item % 5 = 0 THEN 'corrected_' ELSE '' END, 'part_', CAST(item % 50 AS VARCHAR), '_stock')) AS key0,
            CASE WHEN o.question <> q.question THEN concat(o.question, '|', q.question) ELSE q.question END AS variants
            FROM q LEFT JOIN old o ON o.request_id = q.request_id AND o.serial = q.serial LEFT JOIN alike l ON l.request_id = q.request_id AND l.question = q.question),
        m1 AS (SELECT *, row_number() OVER (PARTITION BY request_id, key0 ORDER BY serial, question) AS turn FROM m0),
        m AS (SELECT *, CASE WHEN turn = 1 THEN key0 ELSE concat(key0, '_', CAST(turn AS VARCHAR)) END AS key FROM m1),
        qc AS (SELECT COALESCE(o.request_id, n.request_id) AS request_id, bool_or((o.key, o.question, o.threshold, o.requirement, o.weight) IS DISTINCT FROM (n.key, n.question, n.threshold, n.requirement, n.weight)) AS changed
            FROM (SELECT *, {place} FROM old) o FULL JOIN (SELECT *, {place} FROM m) n ON o.request_id = n.request_id AND o.place = n.place GROUP BY 1),
        was AS (SELECT request_id, line_no AS serial, concat('file-', CAST(line_no AS VARCHAR)) AS name, CAST(quantity % 2 AS VARCHAR) AS note FROM b),
        now AS (SELECT was.request_id, was.serial, name, CAST(a.quantity % 2 AS VARCHAR) AS note FROM was JOIN a ON a.request_id = was.request_id AND a.line_no = was.serial),
        fc AS (SELECT COALESCE(o.request_id, n.request_id) AS request_id, bool_or((o.name, o.note) IS DISTINCT FROM (n.name, n.note)) AS changed
            FROM (SELECT *, {place} FROM was) o FULL JOIN (SELECT *, {place} FROM now) n ON o.request_id = n.request_id AND o.place = n.place GROUP BY 1)
        SELECT request_id, 'question' AS part, serial, key, question AS text, variants, requirement, weight, changed FROM m JOIN qc USING (request_id)
        UNION ALL SELECT request_id, 'file', serial, name, note, NULL, NULL, NULL, changed FROM now JOIN fc USING (request_id)"""
    made["document_lines"] = f"""WITH b AS ({snap[0]}), a AS ({snap[1]}),
        ex AS (SELECT request_id, line_no, concat('P-', CAST(item % 4 AS VARCHAR)) AS c, quantity, row_number() OVER (PARTITION BY request_id, item % 4 ORDER BY line_no) AS turn FROM b),
        nw AS (SELECT request_id, line_no, concat('Widget no ', CAST(item AS VARCHAR), ' large') AS description, nullif(quantity % 7, 0) AS quantity, CASE WHEN item % 3 <> 0 THEN concat('P-', CAST(item % 4 AS VARCHAR))
            ELSE upper(replace(trim(substring(concat('Widget no ', CAST(item AS VARCHAR), ' large'), 1, 12)), ' ', '-')) END AS c FROM a WHERE item % 11 <> 0),
        k AS (SELECT request_id, c, count(*) AS m FROM ex GROUP BY 1, 2),
        n AS (SELECT nw.*, COALESCE(m, 0) AS m, row_number() OVER (PARTITION BY nw.request_id, nw.c ORDER BY line_no) + CASE WHEN m > 0 THEN 1 ELSE 0 END AS turn FROM nw LEFT JOIN k ON k.request_id = nw.request_id AND k.c = nw.c)
        SELECT request_id, line_no, CASE WHEN turn = 1 THEN c ELSE concat(c, '-', CAST(turn AS VARCHAR)) END AS sku, 'kept' AS description, quantity, 'buyer' AS origin FROM ex
        UNION ALL SELECT request_id, line_no + 1099511627776, CASE WHEN turn = 1 THEN c ELSE concat(c, '-', CAST(turn + greatest(m - 1, 0) AS VARCHAR)) END, description, quantity, 'document' FROM n"""
    made["folder_lines"] = f"WITH l AS (SELECT lang, unnest({LINES_OF.format('text')}) AS line FROM documents WHERE text IS NOT NULL) SELECT lang, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM l WHERE trim(line) <> '' GROUP BY 1"
    made["request_catalogue"] = f"""WITH b AS ({snap[0]}), p AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY line_no) AS n FROM b WHERE request_id % 97 <> 0)
        SELECT CAST(request_id AS VARCHAR) AS request_id, concat('Order ', request_id) AS title, request_id % 30 AS window_days, CAST(request_id % 3 AS VARCHAR) AS basis, n AS line_no, CASE WHEN item % 5 <> 0 THEN concat('P-', item) END AS sku,
        concat(CASE WHEN item % 5 = 0 THEN 'plain ' ELSE 'part ' END, item) AS description, CASE WHEN item % 5 = 0 THEN NULL WHEN item % 7 = 0 THEN 1000 + item % 1000 ELSE quantity END AS quantity, CASE WHEN item % 5 <> 0 AND item % 7 <> 0 THEN 'per box' ELSE 'per unit' END AS canonical_unit FROM p
        UNION ALL SELECT DISTINCT CAST(request_id AS VARCHAR), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM b WHERE request_id % 97 = 0"""
    made["vendor_directory"] = "SELECT c_mktsegment AS category_key, c_name AS vendor, c_custkey % 10 IN (0, 1) AS incumbent, CAST(5 + c_custkey % 6 AS DOUBLE) AS quality, CASE WHEN c_custkey % 7 <> 0 THEN 4 + c_custkey % 5 + 0.5 END::DOUBLE AS delivery, CAST(c_nationkey AS VARCHAR) AS rank FROM customer"
    part = lambda source, label, low, of: f"SELECT '{source}' AS source, {label} AS label, count(*) AS n, {low} AS low FROM ({of}) GROUP BY 2"
    made["stored_comparison"] = " UNION ALL ".join([
        part("rfx_lines", "canonical_unit", "CAST(min(quantity) AS DOUBLE)", f"WITH {ITEMS} SELECT * FROM items"),
        part("vendors", "CAST(CAST(meets_requirements AS INT) AS VARCHAR)", "CAST(min(coverage_quoted) AS DOUBLE)", made["vendor_summary"]),
        part("questionnaire", "verdict", "min(score)", made["questionnaire"]),
        part("terms", "k", "min(v)", "SELECT k, CASE WHEN k = 'discount' THEN CAST(s_suppkey % 4 AS DOUBLE) + 0.5 END AS v FROM supplier, (SELECT unnest(['freight', 'payment', 'discount']) AS k)"),
        part("quotes", "status", "min(canonical_value)", made["normalized_quotes"]),
        part("award", "status", "min(price)", made["award_lines"]),
        part("comparison", "status", "min(extended_value)", made["comparison_view"]),
    ])
    # The rungs below the codes, over the distinct wordings no code placed.
    worded = f"""mixed AS (SELECT {cols({k: I.SUPPLIER_COLUMNS[k] for k in HEADER})}, {cols(I.LINE_COLUMNS | {'description': I.MIXED_DESCRIPTION})} FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""
    read_codes = MATCHED.strip().split(",\nmatched AS")[0].replace("FROM lines)", "FROM mixed)")
    rungs = f"""texts AS (SELECT DISTINCT description AS text FROM coded WHERE description IS NOT NULL AND (code IS NULL OR code NOT IN (SELECT sku FROM items))), {VOCAB},
        hits AS (SELECT size, CAST(sum(copies) AS BIGINT) AS n FROM cat WHERE len(size) = 2 GROUP BY 1),
        sized AS (SELECT t.text, c.sku AS found, 0.88::DOUBLE AS conf FROM txt t JOIN hits h ON h.size = t.size AND h.n = 1 JOIN cat c ON c.size = t.size WHERE {OK_PAIR}
            UNION ALL SELECT t.text, min(c.sku), 0.85::DOUBLE FROM txt t JOIN hits h ON h.size = t.size AND h.n > 1 JOIN cat c ON c.size = t.size WHERE len(list_intersect(t.marks, c.marks)) > 0 GROUP BY 1 HAVING sum(c.copies) = 1),
        pairs AS (SELECT t.text, c.sku, c.copies, c.description, {pair_score} AS score FROM (SELECT * FROM txt WHERE text NOT IN (SELECT text FROM sized)) t JOIN cat c ON {OK_PAIR}),
        top AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC, description) AS rn, lead(score) OVER (PARTITION BY text ORDER BY score DESC, description) AS nxt FROM pairs),
        lead AS (SELECT text, sku, score, CASE WHEN copies > 1 THEN score ELSE nxt END AS nxt FROM top WHERE rn = 1),
        said AS (SELECT text, found, 'dimensions' AS basis, conf FROM sized UNION ALL SELECT text, sku, 'description', score FROM lead
            WHERE CASE WHEN nxt IS NULL THEN score >= 0.58 ELSE (score >= 0.58 AND score - nxt >= 0.06) OR (score >= 0.52 AND score - nxt >= 0.25) END),
        matched AS (SELECT c.*, COALESCE(b.sku, w.sku) AS rfx_sku, COALESCE(b.canonical_unit, w.canonical_unit) AS canonical_unit, COALESCE(b.unit_family, w.unit_family) AS unit_family, COALESCE(b.line_no, w.line_no) AS line_no,
            CASE WHEN b.sku IS NOT NULL THEN CASE WHEN upper(trim(vendor_sku)) = code THEN 'exact_sku' ELSE 'normalized_sku' END ELSE COALESCE(basis, 'unmatched') END AS match_basis,
            CASE WHEN b.sku IS NOT NULL THEN CASE WHEN upper(trim(vendor_sku)) = code THEN 1.0 ELSE 0.97 END ELSE COALESCE(conf, 0.0) END::DOUBLE AS match_confidence
            FROM coded c LEFT JOIN items b ON c.code = b.sku LEFT JOIN said t ON b.sku IS NULL AND t.text = c.description LEFT JOIN items w ON w.sku = t.found),
        placed AS (SELECT * FROM matched WHERE rfx_sku IS NOT NULL QUALIFY row_number() OVER (PARTITION BY vendor, rfx_sku ORDER BY match_confidence DESC, line_ord, line_id) = 1)"""
    ladder = f"WITH {ITEMS}, {vendors('supplier')}, {worded}, {read_codes}, {rungs}"
    made["match_ladder"] = f"{ladder} SELECT line_id, rfx_sku, match_basis, match_confidence FROM matched"
    made["ladder_cells"] = f"{ladder}, {cells().strip()} SELECT rfx_sku, vendor, original_value, canonical_value, rules, status, flags, comparable, match_basis, match_confidence FROM cell"
    made["ladder_unplaced"] = f"{ladder}, {UNPLACED} SELECT * FROM unplaced"
    made["ladder_award"] = f"{ladder}, {cells().strip()}, {AWARD} SELECT rfx_sku, winner, price, extended, runner_up, runner_up_price, contenders, status FROM award"
    made["sql_shown"] = f"SELECT rfx_sku, winner, price, count(*) OVER () > 200 AS truncated FROM ({made['award_lines']}) WHERE winner IS NOT NULL ORDER BY price DESC, rfx_sku LIMIT 200"
    return made
