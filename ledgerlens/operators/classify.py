"""Row identity, category, duplicates and status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlens import contract as C
from ledgerlens.functions import text as X
from ledgerlens.session import broadcast_if_small, materialize

RAW_TEXT = (
    "source_id fuente dataset ano mes periodo unidad_ejecutora nombre_completo "
    "gastos_operacionales monto source_url raw_file raw_body_sha256 fecha_captura_utc"
).split()
#: So many repeated ids, and bytes of them, are broadcast.
REPEATED_IDS, REPEATED_BYTES = 1 << 20, 64 << 20
#: Rows of one id that are brought to one task.
HOT_ROWS = 100_000
#: Bits of an id's hash that tell, where many ids repeat, which may: a bitmap of at most 32 MB.
HASH_BITS = 28
SIGNATURE = ["periodo", "unidad_ejecutora", "nombre_completo_raw", "categoria_raw", "monto_raw"]


def clean_cells(df: DataFrame, columns: Sequence[str] = RAW_TEXT) -> DataFrame:
    """Clean the named text cells; columns the source lacks become ''."""
    present = set(df.columns)
    return df.withColumns(
        {c: X.clean_cell(c) if c in present else F.lit("") for c in columns})


def order_key(order_by: Sequence[str]) -> Column:
    """One comparable value for a total-order key; a single column stays as it is."""
    return F.col(order_by[0]) if len(order_by) == 1 else F.struct(*order_by)


def alias_table(spark: SparkSession) -> DataFrame:
    """The fixed 20-entry alias list as (alias_key, alias_id, alias_name)."""
    rows = ", ".join(
        "('{}', '{}', '{}')".format(key, *target) for key, target in C.CATEGORY_ALIASES.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS a(alias_key, alias_id, alias_name)")


def with_category(
    df: DataFrame,
    raw: str = "gastos_operacionales",
    aliases: DataFrame | None = None,
    *,
    cleaned: bool = False,
) -> DataFrame:
    """Add categoria_id, categoria_nombre and categoria_key for a raw category cell.

    The built-in alias list is fixed and small, so it is broadcast; a caller's own
    list is left to the size check of the optimizer.
    """
    lookup = F.broadcast(alias_table(df.sparkSession)) if aliases is None else aliases
    keyed = df.withColumn("categoria_key", X.category_key(raw, cleaned=cleaned))
    joined = keyed.join(lookup, F.expr("categoria_key = alias_key"), "left")
    slug = X.sql_slugify("categoria_key", cleaned=True)
    return joined.withColumns({
        "categoria_id": F.expr(
            f"CASE WHEN categoria_key = '' THEN '{C.NO_CATEGORY[0]}' "
            f"ELSE coalesce(alias_id, {slug}) END"),
        "categoria_nombre": F.when(
            F.expr("categoria_key = ''"), C.NO_CATEGORY[1]
        ).otherwise(F.coalesce("alias_name", X.sentence_case("categoria_key"))),
    }).drop("alias_key", "alias_id", "alias_name")


def entity_id(
    unit: str,
    name: str,
    *,
    unit_prefix: str = C.UNIT_ID_PREFIX,
    name_prefix: str = C.NAME_ID_PREFIX,
) -> Column:
    """Unit code if there is one, else the slug of the name; both are cleaned cells."""
    return F.expr(
        f"CASE WHEN {unit} <> '' THEN concat('{unit_prefix}', {unit}) "
        f"ELSE concat('{name_prefix}', {X.sql_slugify(name, cleaned=True)}) END")


def entity_id_source(unit: str) -> Column:
    return F.expr(
        f"CASE WHEN {unit} <> '' THEN '{C.ID_FROM_UNIT}' ELSE '{C.ID_FROM_NAME}' END")


def with_entity(
    df: DataFrame,
    unit: str = "unidad_ejecutora",
    name: str = "nombre_completo",
    *,
    cleaned: bool = False,
    **prefixes,
) -> DataFrame:
    rows = df if cleaned else clean_cells(df, [unit, name])
    return rows.withColumns({
        "parlamentario_id": entity_id(unit, name, **prefixes),
        "parlamentario_id_source": entity_id_source(unit),
    })


def repeated_hashes(df: DataFrame, *, id_col: str = "source_id") -> DataFrame:
    """``__hash`` and ``__n`` rows of the 64-bit hashes of non-blank ids that occur more than once.

    Counted map-side: eight bytes and a count of each id are shuffled, and no row.
    """
    hashed = df.where(f"{id_col} <> ''").select(F.xxhash64(id_col).alias("__hash"))
    counts = hashed.groupBy("__hash").agg(F.count(F.lit(1)).alias("__n"))
    return materialize(counts.where("__n > 1"), "repeated")


def repeated_firsts(
    df: DataFrame, hashes: DataFrame, *, order_by: Sequence[str], id_col: str = "source_id"
) -> DataFrame:
    """id and ``__first``, the order key of its first row, of ids that occur more than once.

    ``hashes`` are those of the ids asked for, few enough to be broadcast; only their rows are grouped.
    """
    hashed = df.where(f"{id_col} <> ''").withColumn("__hash", F.xxhash64(id_col))
    firsts = hashed.join(F.broadcast(hashes.select("__hash")), "__hash").groupBy(id_col).agg(
        F.count(F.lit(1)).alias("__n"), F.min(order_key(order_by)).alias("__first"))
    return materialize(firsts.where("__n > 1").select(id_col, "__first"), "firsts")


def mark_duplicates(
    df: DataFrame,
    *,
    order_by: Sequence[str],
    id_col: str = "source_id",
    flag: str = "is_duplicate",
    most: int = REPEATED_IDS,
    hot_rows: int = HOT_ROWS,
    row_id: str | None = None,
    store: bool = False,
    ids: DataFrame | None = None,
) -> DataFrame:
    """Flag the second and later rows of a non-blank id.

    Where at most ``most`` ids repeat, and REPEATED_BYTES of them, their firsts are broadcast and no
    row is shuffled.  Otherwise rows are shuffled once, by their id, and a window takes the first of
    each.  Blank ids, and those of more than ``hot_rows`` rows, are dealt by their order key instead;
    the latter, of which there cannot be many, are held against broadcast firsts.

    ``row_id`` names a column of rows of stored files with a bigint of their own, from 0 up and never null,
    the same at every reading; with ``store`` the rows are stored with such a column for the time, if they
    have none.  Then only ids and order keys are shuffled, and the rows get their flag from a bitmap by
    ``row_id``, a bit for each row.  ``ids`` has the id, order key and ``row_id`` of every row of ``df``
    where these take less to read than its rows, say no joins; rows that a join repeats may be there once.
    """
    keyed = df if ids is None else ids
    hashes = repeated_hashes(keyed, id_col=id_col)
    if hashes.count() <= most:
        few = repeated_firsts(keyed, hashes, order_by=order_by, id_col=id_col)
        size = few.agg(F.coalesce(F.sum(F.octet_length(id_col)), F.lit(0)).alias("bytes")).first()
        if size.bytes <= REPEATED_BYTES:
            return _flagged(_with_firsts(df, few, id_col), order_by, F.col("__first"), flag).drop("__first")
    if row_id is None and not store:
        return _flagged_by_id(df, hashes, order_by, id_col, flag, hot_rows)
    rows, number = df, row_id or "__row"
    if row_id is None:
        rows = keyed = materialize(df.withColumn(number, F.monotonically_increasing_id()), "rows")
    keys = keyed.where(f"{id_col} <> ''").select(*dict.fromkeys([id_col, *order_by, number]))
    keys = _perhaps_repeated(keys, hashes, id_col)
    later = _flagged_by_id(keys, hashes, order_by, id_col, flag, hot_rows).where(flag)
    return _with_bits(rows, later, number, flag).select(*[c for c in df.columns if c != flag], flag)


def _flagged_by_id(
    df: DataFrame, hashes: DataFrame, order_by: Sequence[str], id_col: str, flag: str, hot_rows: int
) -> DataFrame:
    """Flagged rows, shuffled by their id."""
    hot = hashes.where(F.col("__n") > hot_rows)
    rows, known = df, F.lit(None)
    alone = ~F.coalesce(F.col(id_col) != "", F.lit(False))
    if not hot.isEmpty():
        hot = repeated_firsts(df, hot, order_by=order_by, id_col=id_col)
        rows = _with_firsts(df, hot.withColumnRenamed("__first", "__known"), id_col)
        known, alone = F.col("__known"), alone | F.col("__known").isNotNull()
    rows = rows.withColumn("__dealt", F.when(alone, F.xxhash64(*order_by)))
    least = F.min(order_key(order_by)).over(W.partitionBy(id_col, "__dealt"))
    first = F.coalesce(known, F.when(F.col("__dealt").isNull(), F.col("__least")))
    return _flagged(rows.withColumn("__least", least), order_by, first, flag).drop("__dealt", "__least", "__known")


def _perhaps_repeated(df: DataFrame, hashes: DataFrame, id_col: str) -> DataFrame:
    """Rows without most of those whose id occurs once: a bitmap tells by some bits of the id's hash."""
    bits = max(15, min(HASH_BITS, (hashes.count() << 4).bit_length()))
    mask = (1 << bits) - 1
    marked = hashes.select(F.col("__hash").bitwiseAND(mask).alias("__low"))
    hashed = df.withColumn("__low", F.xxhash64(id_col).bitwiseAND(mask))
    return _with_bits(hashed, marked, "__low", "__some").where("__some").select(*df.columns)


def _with_bits(df: DataFrame, marked: DataFrame, number: str, flag: str) -> DataFrame:
    """Flags the rows whose ``number``, from 0 up, is among those of ``marked``: bitmaps of 32,768 numbers."""
    place = f"bitmap_bit_position({number})"
    placed = marked.selectExpr(f"bitmap_bucket_number({number}) AS __bucket", f"{place} AS __bit")
    bits = placed.repartition("__bucket").groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    bits = broadcast_if_small(materialize(bits, "bits"))
    byte = f"ascii(decode(substring(__bits, cast({place} div 8 AS int) + 1, 1), 'ISO-8859-1'))"
    found = F.expr(f"getbit({byte}, cast({place} % 8 AS int)) = 1")
    joined = df.join(bits, F.bitmap_bucket_number(number) == F.col("__bucket"), "left")
    return joined.withColumn(flag, F.coalesce(found, F.lit(False))).drop("__bucket", "__bits")


def _with_firsts(df: DataFrame, firsts: DataFrame, id_col: str) -> DataFrame:
    firsts = F.broadcast(firsts.withColumnRenamed(id_col, "__id"))
    return df.join(firsts, F.col(id_col) == F.col("__id"), "left").drop("__id")


def _flagged(df: DataFrame, order_by: Sequence[str], first: Column, flag: str) -> DataFrame:
    later = first.isNotNull() & (order_key(order_by) != first)
    return df.withColumn(flag, F.coalesce(later, F.lit(False)))


def id_groups(
    df: DataFrame,
    *,
    id_col: str = "source_id",
    signature: Sequence[str] = SIGNATURE,
) -> DataFrame:
    """Ids seen more than once: row count and whether their contents differ.

    Contents are compared by two 64-bit hashes, nulls told from blanks, whose minima and maxima are
    plain numbers: a hash aggregate, with partial sums before the shuffle.
    """
    cells = [*signature, *[F.col(c).isNull() for c in signature]]
    hashes = {"__a": F.xxhash64(*cells), "__b": F.xxhash64(F.lit(1), *cells)}
    groups = df.where(F.col(id_col) != "").select(id_col, *[h.alias(n) for n, h in hashes.items()]).groupBy(id_col).agg(
        F.count(F.lit(1)).alias("registros"),
        *[f(n).alias(f"{n}_{k}") for n in hashes for k, f in (("low", F.min), ("high", F.max))])
    differ = " OR ".join(f"{n}_low <> {n}_high" for n in hashes)
    return groups.where("registros > 1").select(id_col, "registros", F.expr(differ).alias("conflicting"))


def row_status(
    *,
    duplicate: str = "is_duplicate",
    raw_category: str = "gastos_operacionales",
    key: str = "categoria_key",
    amount: str = "monto",
) -> Column:
    """Status by precedence, from a cleaned category cell, its key and the parsed amount."""
    return F.expr(f"""CASE
        WHEN {duplicate} THEN '{C.STATUS_DUPLICATE}'
        WHEN {raw_category} = '' THEN '{C.STATUS_NO_CATEGORY}'
        WHEN startswith({key}, '{C.NOTE_PREFIX}') THEN '{C.STATUS_NOTE}'
        WHEN {amount} IS NULL AND {raw_category} RLIKE {X.quoted(C.MONEY_TEXT_PATTERN)}
            THEN '{C.STATUS_AMOUNT_IN_TEXT}'
        WHEN {amount} IS NULL THEN '{C.STATUS_NO_AMOUNT}'
        WHEN {amount} < 0 THEN '{C.STATUS_ADJUSTMENT}'
        ELSE '{C.STATUS_OK}' END""")


def classify_rows(
    expenses: DataFrame,
    *,
    order_by: Sequence[str],
    aliases: DataFrame | None = None,
    cleaned: bool = False,
    ids: DataFrame | None = None,
    **duplicates,
) -> DataFrame:
    """Clean rows without the display name: every column that needs only the row itself,
    plus the duplicate flag.  The columns of ``order_by`` are kept; ``ids``, as raw as
    ``expenses``, and ``duplicates`` go to ``mark_duplicates``."""
    rows = expenses if cleaned else clean_cells(expenses)
    if ids is not None and not cleaned:
        ids = clean_cells(ids, [c for c in RAW_TEXT if c in ids.columns])
    rows = mark_duplicates(rows, order_by=order_by, ids=ids, **duplicates)
    rows = with_entity(with_category(rows, aliases=aliases, cleaned=True), cleaned=True)
    rows = rows.withColumns({
        "monto_raw": F.col("monto"), "monto": X.parse_amount("monto", cleaned=True)})
    rows = rows.withColumn("row_status", row_status())
    derived = {
        "include_in_ranking": f"row_status = '{C.STATUS_OK}'",
        "exclusion_reason": f"CASE WHEN row_status = '{C.STATUS_OK}' THEN '' ELSE row_status END",
        "nombre_completo_raw": "nombre_completo",
        "categoria_raw": "gastos_operacionales",
    }
    have = set(rows.columns)
    produced = [c for c in C.CLEAN_COLUMNS if c not in order_by and (c in have or c in derived)]
    return rows.selectExpr(
        *[f"{derived[c]} AS {c}" if c in derived else c for c in produced], *order_by)


def name_catalogue(
    *tables: DataFrame, unit: str = "unidad_ejecutora", name: str = "nombre_completo"
) -> DataFrame:
    """One display name per entity over all tables: mixed case first, then frequency, then text.

    Cells are counted as they come, then cleaned: rows are many, spellings are few.
    """
    names = None
    for table in tables:
        part = table.groupBy(F.col(unit).alias("__unit"), F.col(name).alias("__name")).agg(
            F.count(F.lit(1)).alias("__n"))
        names = part if names is None else names.unionByName(part)
    spelled = clean_cells(names, ["__unit", "__name"])
    counted = spelled.where("__name <> ''").groupBy(
        entity_id("__unit", "__name").alias("parlamentario_id"), "__name"
    ).agg(F.sum("__n").alias("__n"))
    score = F.struct(X.has_lower("__name"), ~X.is_upper("__name"), "__n", "__name")
    chosen = counted.groupBy("parlamentario_id").agg(F.max_by("__name", score).alias("__name"))
    return chosen.select(
        "parlamentario_id",
        X.display_person_name("__name", cleaned=True).alias("parlamentario_nombre"))


def with_entity_name(
    df: DataFrame, names: DataFrame, raw_name: str | None = "nombre_completo_raw"
) -> DataFrame:
    """Catalogue name, else the row's own name as displayed.

    No broadcast hint: the catalogue grows with the entities.  The optimizer
    broadcasts it when its measured size allows, else splits skewed entities.
    """
    fallback = X.display_person_name(raw_name, cleaned=True) if raw_name else F.lit("")
    joined = df.drop("parlamentario_nombre").join(names, "parlamentario_id", "left")
    return joined.withColumn("parlamentario_nombre", F.coalesce("parlamentario_nombre", fallback))
