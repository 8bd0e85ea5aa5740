"""Registered queries; every one runs over whole tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens import contract as C
from ledgerlens.functions import casts as K
from ledgerlens.functions import text as X
from ledgerlens.functions.periods import index_label, month_index, usable_period_range
from ledgerlens.operators import classify, digests, lineage, period_sets, quality, ranking, registry, rules
from ledgerlens.operators.numbering import number_rows
from ledgerlens.plans import normalize as N
from ledgerlens.plans import publish as P
from ledgerlens.plans import release, serve
from ledgerlens.plans import store as V
from ledgerlens.session import broadcast_if_small, materialize, scratch_path
from ledgerlens.sources import csv_files, raw_json
from workload import facade as A

QUERIES = {}
SUMMARY_FILTERS = {
    "category_id": "promo", "period_from": "1996-03", "period_to": "2000-10", "search": "r#00"}
ENTITY = "senado_unidad_7"
#: Cells of an expense row that the ranking depends on.
RANKED_COLUMNS = [
    "source_id", "ano", "mes", "periodo", "unidad_ejecutora", "nombre_completo", "gastos_operacionales", "monto"]
#: Pages of at most 500 items in one landed file.
LANDED_PAGES = 64
#: Slim rows of a month that one task sorts and pages, some 800 MB; months of more are spread.
LANDED_MONTH = 4 << 20


def query(f):
    QUERIES[f.__name__] = f
    return f


def _classified(spark, sf) -> DataFrame:
    return classify.classify_rows(A.expenses(spark, sf), order_by=A.ORDER)


def _clean(spark, sf) -> DataFrame:
    lines = A.numbered_lines(spark, sf)
    return N.clean_rows(
        A.expenses(spark, sf, lines), A.entities(spark, sf), order_by=A.ORDER,
        row_id=A.LINE_ID, ids=A.expense_ids(lines))


def _names(spark, sf) -> DataFrame:
    return classify.name_catalogue(A.expenses(spark, sf), A.entities(spark, sf))


def _groups(spark, sf) -> DataFrame:
    """The ranking table without its rank column, which the serving views drop."""
    lines = A.numbered_lines(spark, sf)
    rows = A.expenses(spark, sf, lines).select(A.LINE_ID, *A.ORDER, *RANKED_COLUMNS)
    rows = classify.classify_rows(rows, order_by=A.ORDER, row_id=A.LINE_ID, ids=A.expense_ids(lines))
    return ranking.ranking_groups(rows, _names(spark, sf), order_by=A.ORDER)


_STORED: dict[tuple[str, str, str], str] = {}


def prepare_serving(spark, sf) -> V.Version:
    """The step before serving: the ranking of the tables as they are now, loaded as a run of a store.

    Done once for each state of the tables; every serving query reads the store's newest version.
    """
    files = csv_files.list_files(spark, f"{sf}/lineitem.parquet", "*")
    state = files.agg(F.coalesce(F.sum(F.xxhash64("path", "modificationTime", "size_bytes").cast(
        "decimal(20,0)")), F.lit(0)).cast("string")).first()[0]
    key = (spark.sparkContext.applicationId, sf, state)
    if key not in _STORED:
        store = scratch_path(spark, "served")
        load = V.stage({"ranking": _groups(spark, sf).withColumn("run_id", F.lit("served"))}, store)
        run = spark.range(1).selectExpr(
            "CAST(null AS bigint) AS id", "'lines' AS dataset", "'served' AS run_id",
            "'2026-01-01' AS generated_at_utc", "'ok' AS status")
        V.commit(V.read_version(spark, store), run, load)
        _STORED[key] = store
    return V.read_version(spark, _STORED[key])


def _view(spark, sf) -> DataFrame:
    ranked = prepare_serving(spark, sf).latest("ranking", "lines")
    return serve.published(ranked.drop("run_id"), A.PUBLISHED_FROM)


# --- classification -------------------------------------------------------------------


@query
def classified_rows(spark, sf):
    return _clean(spark, sf).select(*[c for c in C.CLEAN_COLUMNS if c != "row_number"])


@query
def status_histogram(spark, sf):
    return quality.status_counts(_classified(spark, sf))


@query
def name_catalogue(spark, sf):
    return _names(spark, sf)


@query
def duplicate_profile(spark, sf):
    return quality.duplicate_profile(_classified(spark, sf))


@query
def conflicting_ids(spark, sf):
    return quality.conflicting_ids(_classified(spark, sf))


@query
def amount_profile(spark, sf):
    return quality.amount_profile(_classified(spark, sf))


@query
def missing_units(spark, sf):
    return quality.missing_unit_rows(_classified(spark, sf))


@query
def problem_examples(spark, sf):
    return quality.problem_examples(_clean(spark, sf), order_by=A.ORDER)


@query
def row_numbers(spark, sf):
    rows = A.table(spark, sf, "lineitem").select(*A.ORDER[:4], "l_shipdate", "l_extendedprice")
    return number_rows(rows, A.ORDER).select(*A.ORDER[:4], "row_number")


# --- ranking and catalogue ----------------------------------------------------------------


@query
def monthly_aggregate(spark, sf):
    return ranking.monthly_aggregate(_classified(spark, sf), order_by=A.ORDER)


@query
def monthly_ranking(spark, sf):
    return ranking.monthly_ranking(
        _classified(spark, sf), _names(spark, sf), order_by=A.ORDER)


@query
def category_catalogue(spark, sf):
    return ranking.category_catalogue(_classified(spark, sf), order_by=A.ORDER)


@query
def category_variants(spark, sf):
    return ranking.category_variants(_classified(spark, sf), order_by=A.ORDER).drop("first_seen")


@query
def category_spellings(spark, sf):
    variants = ranking.category_variants(_classified(spark, sf), order_by=A.ORDER)
    return ranking.category_spellings(variants)


# --- periods ---------------------------------------------------------------------------------


@query
def period_profile(spark, sf):
    periods = period_sets.distinct_periods(A.expenses(spark, sf), A.table(spark, sf, "orders")
                                           .select(A.year_month("o_orderdate")
                                                   .alias("periodo")))
    return quality.period_profile(periods).withColumn(
        "missing_in_range", F.array_join("missing_in_range", ", "))


def _order_months_with_gaps(spark, sf):
    """Months of all orders but every fifth month."""
    return A.table(spark, sf, "orders").where(
        "(year(o_orderdate) * 12 + month(o_orderdate)) % 5 <> 0").select(
        A.year_month("o_orderdate").alias("periodo"))


@query
def missing_periods(spark, sf):
    return period_sets.missing_periods(_order_months_with_gaps(spark, sf))


@query
def public_missing_periods(spark, sf):
    return period_sets.public_missing_periods(
        period_sets.missing_periods(_order_months_with_gaps(spark, sf)), "1998-06")


@query
def selected_periods(spark, sf):
    months = period_sets.distinct_periods(A.expenses(spark, sf))
    return period_sets.select_periods(
        months, year=1999, start="1999-03", end="2000-02", max_periods=6)


@query
def period_indexes(spark, sf):
    i = month_index("periodo")
    return period_sets.distinct_periods(A.expenses(spark, sf)).select(
        "periodo", i.alias("month_index"), index_label(i + 1).alias("next_period"))


# --- serving ----------------------------------------------------------------------------------


@query
def entity_ranking(spark, sf):
    summary = serve.filtered_entity_summary(_view(spark, sf), **SUMMARY_FILTERS)
    return serve.sort_summaries(serve.with_zeroes(summary), "promedio_mensual", "desc")


@query
def entity_summary(spark, sf):
    return serve.entity_summary(_view(spark, sf))


@query
def entity_lookup(spark, sf):
    return serve.entity_lookup(_view(spark, sf), ENTITY)


@query
def category_summary(spark, sf):
    return serve.category_summary(_view(spark, sf))


@query
def top_categories(spark, sf):
    return serve.categories_by_total(_view(spark, sf), 8)


@query
def period_summary(spark, sf):
    return serve.period_summary(_view(spark, sf))


@query
def newest_periods(spark, sf):
    return serve.newest_periods(_view(spark, sf), 8)


@query
def period_range(spark, sf):
    return serve.period_range(_view(spark, sf))


@query
def effective_range(spark, sf):
    start, end = usable_period_range("1997-13", "1999-05")
    return serve.effective_range(_view(spark, sf), start, end)


@query
def entity_categories(spark, sf):
    return serve.entity_categories(
        _view(spark, sf), ENTITY, period_from="1996-05", period_to="2000-12")


@query
def entity_periods(spark, sf):
    return serve.entity_periods(
        _view(spark, sf), ENTITY, period_from="1996-05", period_to="2000-12")


@query
def headline_totals(spark, sf):
    return serve.headline_totals(
        serve.filtered_entity_summary(_view(spark, sf), **SUMMARY_FILTERS))


@query
def share_of_max(spark, sf):
    summary = serve.filtered_entity_summary(_view(spark, sf), period_from="1999-01")
    return serve.share_of_max(summary).select(
        "parlamentario_id", "promedio_mensual", F.round("share", 6).alias("share"))


@query
def summary_positions(spark, sf):
    start, end = usable_period_range("2000-06", "1998-02")
    summary = serve.filtered_entity_summary(
        _view(spark, sf), period_from=start, period_to=end)
    return serve.summary_positions(summary, "registros", "asc").select(
        "position", "parlamentario_id", "registros")


@query
def ranking_orders(spark, sf):
    """The ranking in all ten orders, with positions."""
    return serve.all_positions(serve.filtered_entity_summary(_view(spark, sf), period_from="1997-01"))


@query
def search_entities(spark, sf):
    c = A.table(spark, sf, "customer")
    return c.where(X.contains_ci("c_name", "MER#0000_1")).select("c_custkey", "c_name")


# --- runs ---------------------------------------------------------------------------------------


@query
def latest_run(spark, sf):
    return registry.latest_run(A.runs(spark, sf).withColumn("dataset", F.lit("orders")), "orders")


@query
def latest_runs(spark, sf):
    return registry.latest_runs(A.runs(spark, sf))


@query
def latest_facts(spark, sf):
    return serve.latest_facts(
        A.run_facts(spark, sf), A.runs(spark, sf), dataset=None, published_from="1996-01")


@query
def latest_ranking(spark, sf):
    return serve.latest_ranking(
        A.run_ranking(spark, sf), A.runs(spark, sf), dataset=None, published_from="1996-01")


@query
def rollback_latest(spark, sf):
    changes = A.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(
        F.col("o_orderkey").cast("string").alias("run_id"), F.lit("error").alias("status"))
    return registry.latest_runs(registry.set_run_status(A.runs(spark, sf), changes)).select(
        "dataset", "run_id", "generated_at_utc")


@query
def run_upsert(spark, sf):
    """Orders up to 1998 are registered; later ones and a re-run of 1998 come in."""
    runs = A.runs(spark, sf)
    current = runs.where("generated_at_utc < '1999-01-01'")
    incoming = runs.where("generated_at_utc >= '1998-01-01'").withColumns({
        "id": F.col("id") + 1_000_000_000, "row_count": F.col("row_count") * 2,
        "status": F.lit("ok")})
    return registry.upsert_runs(current, incoming)


@query
def deleted_runs(spark, sf):
    errors = A.runs(spark, sf).where("status = 'error'")
    return registry.delete_runs(A.run_facts(spark, sf), errors).groupBy("periodo").agg(
        F.count(F.lit(1)).alias("rows"))


@query
def orphan_facts(spark, sf):
    ok = A.runs(spark, sf).where("status <> 'partial'")
    return rules.orphans(A.run_facts(spark, sf), ok)


# --- load types and rules ---------------------------------------------------------------------------


@query
def typed_load(spark, sf):
    line, price = F.col("l_linenumber"), F.floor("l_extendedprice").cast("string")
    amount = (
        F.when(line == 1, price).when(line == 2, F.concat(price, F.lit(".75")))
        .when(line == 3, "n/a").when(line == 4, "").when(line == 5, "1e3")
        .when(line == 6, F.concat(F.lit(" -"), price, F.lit(".9 "))))
    flag = F.element_at(
        F.array(*[F.lit(v) for v in ("TRUE", "1", " yes", "Si", "no", "", "0")]), line)
    t = A.table(spark, sf, "lineitem").select(
        *A.ORDER[:4], "l_extendedprice", amount.alias("amount"), flag.alias("flag"))
    return t.select(
        *A.ORDER[:4], F.floor(F.col("l_extendedprice") * 100 + 0.5).alias("cents"),
        K.text_or_empty("amount").alias("amount_text"), K.lenient_int("amount").alias("amount"),
        K.lenient_bool("flag").alias("flag"))


@query
def run_rule_violations(spark, sf):
    return rules.violations(A.runs(spark, sf), rules.run_rules(), ["run_id"])


@query
def fact_rule_violations(spark, sf):
    return rules.violation_counts(A.run_facts(spark, sf), rules.fact_rules())


@query
def ranking_rule_violations(spark, sf):
    return rules.violation_counts(A.run_ranking(spark, sf), rules.ranking_rules())


@query
def manifest_rule_violations(spark, sf):
    manifests = A.runs(spark, sf).withColumnRenamed("manifest_r2_key", "r2_manifest_key")
    requested = F.when(F.col("status") == "error", "").otherwise(F.col("id").cast("string"))
    downloaded = F.when(F.col("status") == "ok", F.col("run_id")).otherwise(
        F.substring("run_id", 2, 20))
    return rules.violations(manifests, {
        **rules.public_manifest_rules(), **rules.run_id_agreement(requested, downloaded),
        **{f"download_{k}": v for k, v in rules.download_manifest_rules(downloaded).items()},
    }, ["run_id"])


@query
def fact_unique_violations(spark, sf):
    return rules.fact_unique_violations(A.run_facts(spark, sf))


@query
def ranking_unique_violations(spark, sf):
    return rules.ranking_unique_violations(A.run_ranking(spark, sf))


@query
def run_unique_violations(spark, sf):
    runs = A.runs(spark, sf).withColumn("run_id", F.concat_ws("-", "dataset", "period_from"))
    return rules.unique_violations(runs, rules.RUN_KEY, rule="run_id")


# --- quality ------------------------------------------------------------------------------------------


def _normalized(spark, sf):
    return N.normalize(
        A.expenses(spark, sf), A.entities(spark, sf), order_by=A.ORDER, source_path="lineitem")


@query
def quality_report(spark, sf):
    r = _normalized(spark, sf).report
    entries = F.array_sort(F.map_entries("row_status_counts"))
    return r.select(
        "source_path", "source_rows", "clean_rows", "included_in_ranking_rows", "ranking_rows",
        "category_rows", F.col("periods.count").alias("period_count"),
        F.col("periods.min").alias("period_min"), F.col("periods.max").alias("period_max"),
        F.array_join("periods.missing_in_range", ", ").alias("missing_in_range"), "amounts.*",
        "identity.missing_unidad_ejecutora_rows", "identity.duplicate_source_id_groups",
        "identity.duplicate_source_id_extra_rows",
        "identity.conflicting_duplicate_source_id_groups",
        F.array_join("identity.conflicting_duplicate_source_id_examples", ", ").alias(
            "conflict_examples"),
        F.array_join(F.transform(entries, lambda e: F.concat(
            e.key, F.lit("="), e.value.cast("string"))), ", ").alias("status_counts"),
        F.aggregate(
            F.map_values("problem_examples"), F.lit(0), lambda n, v: n + F.size(v)
        ).cast("bigint").alias("examples"),
        F.array_join("warnings", " / ").alias("warnings"))


@query
def publication_gate(spark, sf):
    return quality.gate_failures(_normalized(spark, sf).report, "1998-01").select(
        F.col("position").cast("bigint").alias("position"), "failure")


@query
def normalized_clean(spark, sf):
    return _normalized(spark, sf).clean.select(
        "row_number", "source_id", "row_status", "parlamentario_nombre", "categoria_id", "monto")


@query
def page_reconciliation(spark, sf):
    """Orders declare four lines each; lines with quantity 3 have a blank id."""
    line = A.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.when(F.col("l_quantity") == 3, "").otherwise(F.col("l_linenumber").cast("string"))
        .alias("source_id"))
    order = A.table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderpriority") != "5-LOW", 4).alias("declared_total"))
    rows = line.join(order, "o_orderkey", "left").withColumn(
        "periodo", F.col("o_orderkey").cast("string"))
    return quality.page_reconciliation(rows, page=None).withColumn(
        "declared_rows", F.col("declared_rows").cast("bigint"))


# --- lineage --------------------------------------------------------------------------------------------


@query
def lineage_check(spark, sf):
    """Manifest of all files but those of five buckets; the last line of an order is stale."""
    rows = A.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity",
        F.concat(F.lit("raw\\"), (F.col("l_orderkey") % 50).cast("string"), F.lit(".json"))
        .alias("file"))
    sha = F.sha2((F.col("l_orderkey") % 50).cast("string"), 256)
    hashes = rows.where(F.col("l_orderkey") % 50 >= 5).select(
        X.manifest_path("file").alias("raw_file"), sha.alias("body_sha256")).distinct()
    used = rows.select(
        F.when(F.col("l_quantity") == 7, " ").otherwise(F.col("file")).alias("raw_file"),
        F.when(F.col("l_linenumber") == 7, "stale").otherwise(sha).alias("raw_body_sha256"))
    return lineage.row_lineage_violations(used, hashes)


@query
def file_suffixes(spark, sf):
    """Source file names built from each order's months, split again."""
    o = A.table(spark, sf, "orders").select(
        A.year_month("o_orderdate").alias("lo"), "o_orderpriority").distinct()
    name = F.concat(
        F.lit("data/processed/senado_gastos_operacionales_"), "lo",
        F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise("_2001-12"), F.lit(".csv"))
    suffix = csv_files.file_suffix(name)
    return o.select(
        name.alias("path"), suffix.alias("suffix"),
        csv_files.suffix_period_from(suffix).alias("period_from"),
        csv_files.suffix_period_to(suffix).alias("period_to"))


def _land_envelopes(spark, sf, x: DataFrame | None = None, *, compression: str = "gzip") -> str:
    """Write the expenses as API pages of at most 500 items, one response per line."""
    x = A.expenses(spark, sf) if x is None else x
    # only what an item holds is numbered: the rows are stored on the way
    held = x.select(*A.ORDER, *RANKED_COLUMNS)
    numbered = number_rows(held, A.ORDER, partition_by=["periodo"], name="n", hot_rows=LANDED_MONTH, keep=RANKED_COLUMNS)
    totals = broadcast_if_small(materialize(x.groupBy("periodo").agg(F.count(F.lit(1)).alias("total")), "totals"))
    attributes = F.struct(
        F.col("ano").cast("int").alias("ano"), "mes", "unidad_ejecutora",
        F.col("nombre_completo").alias("nombre"), F.lit("").alias("appaterno"),
        F.lit(None).cast("string").alias("apmaterno"), "gastos_operacionales", "monto")
    item = F.struct(F.nullif("source_id", F.lit("")).alias("id"), attributes.alias("attributes"))
    page = F.floor((F.col("n") - 1) / C.PAGE_SIZE) + 1
    # A page holds at most 500 rows by its number, so the lists below are bounded.
    pages = numbered.groupBy("periodo", page.alias("page")).agg(
        F.array_sort(F.collect_list(F.struct("n", item.alias("item")))).alias("rows"))
    pages = pages.join(totals, "periodo")
    pagination = F.struct(
        "page", F.lit(C.PAGE_SIZE).alias("pageSize"),
        F.ceil(F.col("total") / C.PAGE_SIZE).alias("pageCount"),
        F.col("total").cast("string").alias("total"))
    data = F.struct(
        F.transform("rows", lambda r: r.item).alias("data"),
        F.struct(pagination.alias("pagination")).alias("meta"))
    body = F.struct(F.lit("ok").alias("status"), F.size("rows").alias("results"),
                    data.alias("data"))
    url = F.concat(F.lit("https://data.example/expenses/"), "periodo", F.lit("/"),
                   F.col("page").cast("string"))
    envelope = F.struct(
        url.alias("source_url"), F.lit(200).alias("status_code"),
        F.lit("2026-01-01T00:00:00+00:00").alias("captured_at_utc"),
        F.sha2(url, 256).alias("body_sha256"), body.alias("body"))
    path = scratch_path(spark, "landing")
    # a received file is read, hashed and kept as one value: many files of some megabytes, packed as pages repeat
    # the names of their fields
    pages.select(F.to_json(envelope, {"ignoreNullFields": "false"})).write.options(
        maxRecordsPerFile=LANDED_PAGES, compression=compression).text(path)
    return path


@query
def raw_ingest(spark, sf):
    envelopes = raw_json.read_envelopes(spark, _land_envelopes(spark, sf), multi_line=False)
    rows = raw_json.expense_rows(envelopes)
    return rows.select(*[
        F.coalesce(c, F.lit("")).alias(c) for c in C.EXPENSE_COLUMNS if c != "raw_file"])


@query
def ingest_reconciliation(spark, sf):
    envelopes = raw_json.read_envelopes(spark, _land_envelopes(spark, sf), multi_line=False)
    rows = raw_json.expense_rows(envelopes, keep_order=True)
    return quality.page_reconciliation(rows)


@query
def entity_ingest(spark, sf):
    """Suppliers of every month as entity responses, one response per month."""
    line = A.table(spark, sf, "lineitem").select(
        F.year("l_shipdate").alias("ano"), F.month("l_shipdate").alias("mes"),
        F.col("l_suppkey").alias("s_suppkey")).distinct()
    s = A.table(spark, sf, "supplier").select("s_suppkey", "s_name")
    item = F.to_json(F.struct(
        "ano", "mes", F.col("s_suppkey").cast("string").alias("unidad_ejecutora"),
        F.concat(F.lit(" "), "s_name", F.lit(" ")).alias("nombre"),
        F.lit("De").alias("appaterno"), F.lit("").alias("apmaterno")))
    text = F.concat(
        F.lit('{"source_url":"https://data.example/entities","captured_at_utc":"2026-01-01",'
              '"body_sha256":"abc","body":{"status":"ok","results":1,"data":['), item,
        F.lit(',"not an object"]}}'))
    payload = line.join(s, "s_suppkey").select(
        F.parse_json(text).alias("payload"), F.lit("entities.json").alias("raw_file"))
    return raw_json.entity_rows(payload)


@query
def available_periods(spark, sf):
    """Every month of the orders as an offered period, flagged when line items shipped in it."""
    o = A.table(spark, sf, "orders").select(
        F.year("o_orderdate").alias("ano"), F.month("o_orderdate").alias("mes")).distinct()
    text = F.format_string(
        '{"source_url":"u","captured_at_utc":"t","body_sha256":"h","body":{"data":{"data":['
        '{"id":%d,"attributes":{"ano":%d,"mes":"%d","endpoint":"e","url":null}}]}}}',
        F.col("ano") * 100 + F.col("mes"), "ano", "mes")
    envelopes = o.select(F.parse_json(text).alias("payload"), F.lit("p.json").alias("raw_file"))
    shipped = A.expenses(spark, sf).where("periodo >= '1997-01'")
    rows = raw_json.available_period_rows(
        envelopes, period_sets.select_periods(shipped, end="2000-06"))
    return rows.select(
        "source_id", "ano", "mes", "periodo", "endpoint", "url", "selected", "source_url")


@query
def json_attributes(spark, sf):
    """Events as API items: attributes, an item field with nested JSON, booleans and nulls."""
    e = A.table(spark, sf, "events")
    text = F.concat(
        F.lit('{"body":{"data":{"data":[{"id":'), F.col("event_id").cast("string"),
        F.lit(',"attributes":'), "props", F.lit(',"kind":{"z":["a:b,\\"c\\"",1],"event":"'),
        "event_type", F.lit('"},"seen":true,"gone":null}]}}}'))
    items = raw_json.page_items(e.select(
        F.parse_json(text).alias("payload"), F.lit("events.json").alias("raw_file")))
    return raw_json.flatten_items(
        items, ["k"], item_columns=["kind", "seen", "gone"]).select(
        "source_id", "k", "item_kind", "item_seen", "item_gone")


@query
def attribute_keys(spark, sf):
    """Names in the attribute bags of all events, with how often each occurs."""
    e = A.table(spark, sf, "events").select(
        F.parse_json(F.concat(F.lit('{"attributes":'), "props", F.lit("}"))).alias("item"))
    return raw_json.attribute_keys(e)


@query
def envelope_checks(spark, sf):
    """Orders as responses: status F answers ok, O answers an error, P has no status."""
    o = A.table(spark, sf, "orders")
    body = (
        F.when(F.col("o_orderpriority") == "5-LOW", '{"body":[1]}')
        .when(F.col("o_orderstatus") == "F", '{"body":{"status":"ok"}}')
        .when(F.col("o_orderstatus") == "O", '{"body":{"status":"error"}}')
        .otherwise('{"body":{"status":null}}'))
    return raw_json.envelope_violations(o.select(
        F.parse_json(body).alias("payload"), F.col("o_orderkey").cast("string").alias("raw_file")))


# --- text over documents and pages -----------------------------------------------------------------------------


@query
def slugify_docs(spark, sf):
    cleaned = A.table(spark, sf, "documents").select("doc_id", X.clean_cell("text").alias("text"))
    return cleaned.select("doc_id", X.slugify("text", cleaned=True).alias("slug"))


@query
def clean_text(spark, sf):
    html = X.clean_cell("html")
    return A.table(spark, sf, "pages").select(
        "page_id", F.length(html).cast("bigint").alias("length"), F.md5(html).alias("digest"))


@query
def document_duplicates(spark, sf):
    d = A.table(spark, sf, "documents").select(
        "doc_id", F.sha2("text", 256).alias("source_id"))
    return classify.mark_duplicates(d, order_by=["doc_id"])


@query
def document_conflicts(spark, sf):
    d = A.table(spark, sf, "documents").select(
        F.sha2("text", 256).alias("source_id"), "lang", "source")
    return classify.id_groups(d, signature=["lang", "source"])


# --- files ----------------------------------------------------------------------------------------------------------


@query
def csv_roundtrip(spark, sf):
    """Conversation turns, with their line breaks and quotes, through a CSV file and back."""
    c = A.table(spark, sf, "conversations").select(
        F.col("turn").cast("string").alias("turn"), F.col("conv_id").cast("string")
        .alias("conv_id"), "role", "text")
    path = scratch_path(spark, "csv")
    csv_files.write_source_csv(c, path, ["conv_id", "turn", "absent"])
    return csv_files.read_csv(spark, path)


@query
def csv_mixed_headers(spark, sf):
    """Files whose headers differ in order and columns, with line breaks in cells, in one folder."""
    c = A.table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("string").alias("turn"), "role",
        F.concat("role", F.lit(' "'), F.col("turn") % 3, F.lit('",\n'), "text").alias("text"))
    path = scratch_path(spark, "csv-mixed")
    kinds = [["conv_id", "turn", "role", "text"], ["text", "conv_id", "turn"], ["turn", "extra", "text", "conv_id"]]
    for k, columns in enumerate(kinds):
        rows = c.where(F.col("conv_id") % 3 == k).withColumn("extra", F.concat(F.lit("e\n"), "turn"))
        csv_files.write_csv(rows, path, columns, mode="append", bom=k != 1)
    return csv_files.read_csv(spark, path)


@query
def latest_snapshot(spark, sf):
    """Of a file, two finished folders, a derived one and one half-written, the newest source is read."""
    directory = scratch_path(spark, "snapshots")
    c = A.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_name")
    for name, rows, marker in (
            ("2012-01_2024-12", c.where("c_custkey % 2 = 0"), True), ("2012-01_2025-12", c, True),
            ("clean_2026", c.limit(0), True), ("2012-01_2026-01", c.where("c_custkey % 3 = 0"), False)):
        rows.write.option("header", True).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", marker).csv(
            f"{directory}/{C.EXPENSE_FILE_PREFIX}{name}")
    return csv_files.read_csv(spark, csv_files.require_latest_snapshot(spark, directory, C.EXPENSE_FILE_PREFIX))


@query
def csv_by_year(spark, sf):
    """Expenses written per year; data rows per year counted from the files."""
    path = scratch_path(spark, "csv-years")
    csv_files.write_csv_by_year(
        A.expenses(spark, sf).select(*A.RAW_COLUMNS), path, C.EXPENSE_COLUMNS)
    counts = csv_files.csv_row_counts(spark, path)
    year = F.regexp_extract("path", r"year=([0-9]+)", 1)
    return counts.where(F.endswith(F.col("path"), F.lit(".csv"))).groupBy(
        year.alias("year")).agg(F.sum("row_count").alias("rows"))


@query
def file_manifest(spark, sf):
    """Pages landed as files, fingerprinted, and checked against their manifest."""
    path = scratch_path(spark, "pages")
    pages = A.table(spark, sf, "pages")
    sha = F.sha2("html", 256)
    payload = F.to_json(F.struct(sha.alias("body_sha256"), F.struct("html").alias("body")))
    pages.select(payload.alias("value"), F.pmod(F.crc32("url"), F.lit(8)).alias("bucket")
                 ).write.partitionBy("bucket").text(path)
    prints = lineage.file_fingerprints(spark, path, pattern="*.txt")
    envelopes = raw_json.read_envelopes(spark, path, multi_line=False)
    records = lineage.raw_file_records(prints, envelopes)
    checked = lineage.manifest_hashes(records, prints, envelopes)
    return checked.groupBy(F.coalesce("rule", F.lit("ok")).alias("rule")).agg(
        F.count(F.lit(1)).alias("responses"),
        F.count_distinct("body_sha256").alias("bodies"))


@query
def load_idempotent(spark, sf):
    """Every dataset-like run loaded twice into one table; the second load replaces the first."""
    facts = A.run_facts(spark, sf).withColumn(
        "run_id", F.concat(F.lit("run-"), F.col("ano").cast("string")))
    path = scratch_path(spark, "facts")
    P.load_table(facts, path)
    P.load_table(facts.where("ano >= 1998"), path)
    stored = spark.read.parquet(path)
    return stored.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("monto").alias("total"))


def _manifest(spark, run_id: str, counts: dict[str, int], /, **changed) -> DataFrame:
    """A pipeline manifest that may be loaded, but for the columns ``changed`` (as SQL)."""
    key = f"{C.PUBLISH_PREFIX}/runs/{run_id}/pipeline_manifest.json"
    files = ", ".join(f"named_struct('name', '{n}', 'row_count', {k}L)" for n, k in counts.items())
    cells = {
        "dataset": f"'{C.DATASET_NAME}'", "run_id": f"'{run_id}'",
        "generated_at_utc": "'2026-01-01T00:00:00+00:00'", "period_from": "'1995-01'",
        "period_to": "'2001-12'", "r2_manifest_key": f"'{key}'",
        "public_manifest_url": f"'https://data.example/{key}'", "output_files": f"array({files})", **changed}
    return spark.range(1).selectExpr(*[f"{value} AS {name}" for name, value in cells.items()])


def _no_violations(spark) -> DataFrame:
    return spark.range(0).selectExpr("'' AS rule")


@query
def publish_roundtrip(spark, sf):
    """Normalised expenses loaded as a run, registered, and served back from the store."""
    result = _normalized(spark, sf)
    store, run_id = scratch_path(spark, "store"), "20260101T000000Z"
    manifest = _manifest(
        spark, run_id, {"clean": result.clean.count(), "ranking_mensual": result.ranking.count()})
    version = P.load_run(
        manifest, result.clean, result.ranking, _no_violations(spark), store=store, run_id=run_id)
    return serve.entity_summary(serve.published(version.latest("ranking"), A.PUBLISHED_FROM))


@query
def publish_run(spark, sf):
    """A whole run: API pages checked against their manifest, normalised, gated, published with records,
    archived, checked again, loaded from the published files and served."""
    expenses = A.expenses(spark, sf).withColumn("source_id", F.lit(""))  # ids repeat: the gate refuses them
    landing, run_id = _land_envelopes(spark, sf, expenses), "20260101T000000Z"
    records = materialize(lineage.raw_file_records(
        lineage.file_fingerprints(spark, landing),
        raw_json.read_envelopes(spark, landing, multi_line=False)), "records")
    download = spark.range(1).selectExpr(f"'{run_id}' AS run_id", "'raw/download_manifest.json' AS r2_manifest_key")
    version = release.release(
        spark, landing, download, records, root=scratch_path(spark, "published"), store=scratch_path(spark, "store"),
        run_id=run_id, generated_at="2026-01-01T00:00:00+00:00", base_url="https://data.example",
        entities=A.entities(spark, sf), multi_line=False, publication_from="1998-01")
    return serve.entity_summary(serve.published(version.latest("ranking"), A.PUBLISHED_FROM))


@query
def load_atomic(spark, sf):
    """What a reader that began before a reload sees, and one after it; a late writer is refused."""
    store = scratch_path(spark, "versions")
    facts = A.run_facts(spark, sf).withColumn("run_id", F.concat(F.lit("run-"), F.col("ano").cast("string")))

    def runs(rows):
        return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(None).cast("bigint").alias("id"), F.lit("lines").alias("dataset"), "run_id", "row_count",
            F.lit("ok").alias("status"))

    first = V.commit(V.read_version(spark, store), runs(facts), V.stage({"facts": facts}, store))
    before = first.table("facts")
    doubled = facts.where("ano >= 1998").withColumn("monto", 2 * F.col("monto"))
    based_on = V.read_version(spark, store)
    V.commit(based_on, runs(doubled), V.stage({"facts": doubled}, store))
    try:  # began before that commit and brings one of its runs
        V.commit(based_on, runs(doubled), V.stage({"facts": doubled.limit(0)}, store))
        late = "committed"
    except V.LoadConflict:
        late = "refused"
    # began before it too, with a run of its own
    other = facts.where("ano = 1997").withColumn("run_id", F.lit("other"))
    V.commit(based_on, runs(other), V.stage({"facts": other}, store))
    after = V.read_version(spark, store).table("facts")
    seen = [rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("monto").alias("total")).select(
        F.lit(name).alias("reader"), "*", F.lit(late).alias("late_writer"))
        for name, rows in (("before", before), ("after", after))]
    return seen[0].unionByName(seen[1])


@query
def load_refusals(spark, sf):
    """Runs that break one precondition each, and the rule that refuses them."""
    result, run_id = _normalized(spark, sf), "20260101T000000Z"
    store = scratch_path(spark, "store")
    counts = {"clean": result.clean.count(), "ranking_mensual": result.ranking.count()}
    base = dict(manifest=_manifest(spark, run_id, counts), clean=result.clean, ranking=result.ranking,
                output_violations=_no_violations(spark))
    changed = {name: _manifest(spark, run_id, counts, **{column: value}) for name, column, value in (
        ("blank_run", "run_id", "' '"), ("other_run", "run_id", "'20250101T000000Z'"),
        ("no_key", "r2_manifest_key", "''"), ("no_url", "public_manifest_url", "''"),
        ("plain_url", "public_manifest_url", "'http://data.example/m.json'"),
        ("odd_start", "period_from", "'1995-13'"), ("odd_end", "period_to", "'2001'"),
        ("backwards", "period_to", "'1994-12'"))}
    cases = {name: {"manifest": manifest} for name, manifest in changed.items()}
    for name, listed in (("no_clean", {"ranking_mensual": 1}), ("no_ranking", {"clean": counts["clean"]}),
                         ("other_count", {**counts, "clean": 7})):
        cases[name] = {"manifest": _manifest(spark, run_id, listed)}
    cases["changed_file"] = {"output_violations": spark.range(1).selectExpr("'changed_part' AS rule")}
    cases["odd_status"] = {"clean": result.clean.withColumn("row_status", F.lit("otro"))}
    cases["repeated_rank"] = {"ranking": result.ranking.withColumn("rank", F.lit(1))}
    outcomes = []
    for name, case in cases.items():
        try:
            P.load_run(**{**base, **case}, store=store, run_id=run_id)
            rule = "loaded"
        except P.LoadError as error:
            rule = re.split("[,:(]", str(error))[0].strip()
        outcomes.append((name, rule))
    left = V.read_version(spark, store).number  # nothing was loaded
    return spark.createDataFrame([(*o, left) for o in outcomes], "run string, rule string, version int")


@query
def output_record_check(spark, sf):
    """Orders published in a folder per priority; each folder is then damaged in one way."""
    base, columns = scratch_path(spark, "outputs"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_clerk"]
    orders = A.table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.concat(F.lit('"'), F.col("o_orderkey") % 7, F.lit(' \n,á')).alias("o_clerk"), "o_orderpriority")
    names = {"1-URGENT": "intact", "2-HIGH": "missing", "3-MEDIUM": "changed", "4-NOT SPECIFIED": "added", "5-LOW": "longer"}
    for priority, name in names.items():
        rows = orders.where(F.col("o_orderpriority") == priority)
        csv_files.write_csv(rows.repartition(3, "o_custkey"), f"{base}/{name}", columns)
    records = materialize(digests.output_folders(spark, base, list(names.values())), "records")
    parts = materialize(digests.folder_parts(spark, base), "parts")
    csv_files.write_csv(orders.where("o_orderpriority = '5-LOW'").coalesce(1), f"{base}/longer", columns, mode="append")
    there = digests.folder_parts(spark, base)
    first = parts.groupBy("name").agg(F.min("part").alias("part")).withColumn("first", F.lit(True))
    there = there.join(first, ["name", "part"], "left").where("name <> 'missing' OR first IS NULL").withColumn(
        "sha256", F.when((F.col("name") == "changed") & F.col("first"), "0" * 64).otherwise(F.col("sha256"))).drop("first")
    extra = spark.range(1).selectExpr("'added' AS name", "'extra.csv' AS part", f"'{'1' * 64}' AS sha256", "5L AS size_bytes")
    found = digests.output_folders(spark, base, list(names.values()))
    wrong = digests.folder_violations(records, parts, found, there.unionByName(extra)).groupBy("name", "rule").agg(
        F.count(F.lit(1)).alias("n"))
    return wrong.select("name", "rule", "n", F.lit("").alias("digest")).unionByName(
        records.select("name", F.lit("").alias("rule"), F.col("row_count").alias("n"), "digest"))


@query
def archive_check(spark, sf):
    """Received API pages kept byte for byte; the kept bytes against the records, whole and damaged."""
    landing = _land_envelopes(spark, sf, compression="none")  # the kept bytes are read as text below
    prints = lineage.file_fingerprints(spark, landing)
    records = materialize(lineage.raw_file_records(
        prints, raw_json.read_envelopes(spark, landing, multi_line=False)), "records")
    said = P.archive_raw(spark, landing, records, scratch_path(spark, "archive"), "20260101T000000Z")
    kept = spark.read.parquet(f"{said['folder']}/files")
    listed = records.select(F.col("local_path").alias("raw_file"), "sha256")
    first = records.agg(F.min("local_path")).scalar()
    content = F.when(F.col("raw_file") == first, F.concat("content", F.lit(b" "))).otherwise(F.col("content"))
    states = {"kept": kept, "longer": kept.withColumn("content", content), "fewer": kept.where(F.col("raw_file") != first)}
    found = [P.archive_violations(listed, rows).groupBy("rule").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(state).alias("state"), "rule", "n") for state, rows in states.items()]
    pages = kept.select(F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("page")).where("page <> ''")
    pages = pages.agg(F.count(F.lit(1)).alias("n")).select(F.lit("kept").alias("state"), F.lit("pages").alias("rule"), "n")
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(pages)


@query
def file_verdicts(spark, sf):
    """One verdict per file of many responses, and the responses that the files in order cover."""
    path = scratch_path(spark, "pages")
    payload = F.to_json(F.struct(F.sha2("html", 256).alias("body_sha256"), F.struct("html").alias("body")))
    A.table(spark, sf, "pages").select(
        payload.alias("value"), F.pmod(F.col("page_id"), F.lit(8)).alias("bucket")
    ).repartition(8, "bucket").write.partitionBy("bucket").text(path)
    prints = lineage.file_fingerprints(spark, path, pattern="*.txt")
    bucket = F.regexp_extract("local_path", "bucket=([0-9]+)", 1)
    records = materialize(prints, "prints").withColumn("sha256", F.when(bucket == "2", "").when(
        bucket == "3", "0" * 64).otherwise(F.col("sha256")))
    verdicts = digests.verdicts(records, prints.where(bucket != "5"))
    bodies = raw_json.read_envelopes(spark, path, multi_line=False).select(
        "raw_file", raw_json.json_text("$.body_sha256").alias("body_sha256"))
    covered = digests.response_hashes(verdicts, bodies).groupBy("raw_file").agg(F.count(F.lit(1)).alias("bodies"))
    return verdicts.join(covered, "raw_file", "left").select(
        F.regexp_extract("raw_file", "bucket=([0-9]+)", 1).alias("bucket"), F.coalesce("rule", F.lit("ok")).alias("rule"),
        F.coalesce("bodies", F.lit(0)).alias("bodies"))
