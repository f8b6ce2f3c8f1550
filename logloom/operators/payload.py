"""Payload leaves, printed values, proofs and perturbation of JSON request bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import squeeze
from ..functions.text import EPOCH_MILLIS, ISO_DATE, NUMBER_TYPE, PLAIN_NUMBER, epoch_days, italian_number, printed_decimals

# Path parts that are never data, and key words that are plumbing or printed amounts.
EXCLUDED = ("template", "attributedescription", "attributeacronym", "documentacquisitioncontext")
EXCLUDED_CONTROL = EXCLUDED + ("associatedroles", "attachment", "attributes")
STRUCTURAL = (
    "id", "ids", "key", "keys", "code", "codes", "codice", "codici", "tipo", "type", "types", "status", "stato",
    "state", "flag", "flags", "template", "ruolo", "role", "roles", "version", "versione", "lang", "language",
    "locale", "lingua", "currency", "valuta", "url", "uri", "href", "link", "mode", "modalita", "enum",
    "channel", "canale", "format", "formato", "timestamp", "order", "ordine", "length", "level", "livello",
    "precision", "number", "position", "quantity", "operation", "count", "index", "sequence", "seq", "ref", "paper",
)
QUALIFIERS = ("tipo", "type", "codice", "cod", "code", "stato", "state", "status", "flag", "is", "has", "id", "max", "min",
              "num", "list", "ref", "order", "ordine")
PRINTED_NUMBERS = (
    "importo", "importi", "prezzo", "prezzi", "price", "amount", "costo", "cost", "quota", "sconto", "discount",
    "durata", "duration", "mesi", "months", "giorni", "days", "anni", "years", "percentuale", "percent",
    "tasso", "rate", "potenza", "power", "consumo", "consumption", "canone", "fee", "spread", "totale", "total", "rata",
)
KEY_WORDS = r"([A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+)"
EDGE = r"^[ .,;:()\[\]]+|[ .,;:()\[\]]+$"
MIN_TEXT, MAX_CELL = 4, 60
SECTION_OPS = ("pagine", "sezione_assente", "sezione_in_piu")


def nesting(payload: Column) -> Column:
    """How deep the objects and arrays of a JSON text are nested; brackets in strings do not count."""
    marks = F.regexp_replace(F.regexp_replace(payload, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', ""), r"[^\[\]{}]", "")
    now = F.struct(F.lit(0).alias("open"), F.lit(0).alias("most"))

    def step(acc: Column, mark: Column) -> Column:
        level = acc["open"] + F.when(mark.isin("{", "["), 1).when(mark.isin("}", "]"), -1).otherwise(0)
        return F.struct(level.alias("open"), F.greatest(acc["most"], level).alias("most"))

    return F.aggregate(F.split(marks, ""), now, step, lambda acc: acc["most"])


def leaves(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Every scalar leaf: (…, path, name, value, kind, ord). Objects and arrays open level by level, all of them.

    The number of levels is the deepest nesting that occurs, counted first; ``ord`` follows the document order of the
    parsed value.
    """
    keep = [c for c in payloads.columns if c != column]
    deepest = payloads.agg(F.max(nesting(F.col(column)))).first()[0] or 0
    node = F.struct(F.lit("").alias("path"), F.lit("").alias("name"), F.array().cast("array<int>").alias("ord"),
                    F.try_parse_json(column).alias("v"))
    level = payloads.select(*keep, node.alias("n")).where(F.col("n.v").isNotNull())
    for _ in range(deepest):
        level = level.select(*keep, F.explode(_children(F.col("n"))).alias("n"))
    kind = F.regexp_extract(F.schema_of_variant("n.v"), r"^[A-Z]+", 0)
    out = level.select(*keep, "n.path", "n.name", F.try_variant_get("n.v", "$", "string").alias("value"), kind.alias("kind"), "n.ord")
    return out.where(~F.col("kind").isin("OBJECT", "ARRAY"))


def _children(n: Column) -> Column:
    """The children of an object or array node; a leaf is its own child, so levels need no union."""
    kind = F.schema_of_variant(n["v"])
    obj = F.map_entries(F.try_variant_get(n["v"], "$", "map<string,variant>"))
    arr = F.try_variant_get(n["v"], "$", "array<variant>")

    def child(path: Column, name: Column, i: Column, v: Column) -> Column:
        return F.struct(path.alias("path"), name.alias("name"), F.concat(n["ord"], F.array(i)).alias("ord"), v.alias("v"))

    of_obj = F.transform(obj, lambda e, i: child(
        F.concat(F.when(n["path"] == "", F.lit("")).otherwise(F.concat(n["path"], F.lit("."))), e["key"]), e["key"], i, e["value"]))
    of_arr = F.transform(arr, lambda v, i: child(F.concat(n["path"], F.lit("["), i.cast("string"), F.lit("]")), n["name"], i, v))
    return F.when(kind.startswith("OBJECT"), of_obj).when(kind.startswith("ARRAY"), of_arr).otherwise(F.array(n))


def payload_index(found: DataFrame, by: list[str]) -> DataFrame:
    """(…, printed, number, path): printed text or number of each data leaf; the first leaf names a value."""
    text = squeeze(F.col("value"))
    low = F.lower("path")
    skip = F.lit(False)
    for part in EXCLUDED:
        skip = skip | low.contains(part)
    rows = found.where(~skip & F.col("value").isNotNull() & ~F.col("kind").isin("BOOLEAN", "VOID")).withColumn("t", text)
    is_text = F.col("kind") == "STRING"
    number = F.when(~is_text | F.col("t").rlike(PLAIN_NUMBER), F.col("t").try_cast(NUMBER_TYPE))
    iso = F.col("t").rlike(ISO_DATE)
    dates = F.when(is_text & F.col("t").rlike(EPOCH_MILLIS), epoch_days("t"))
    plain = is_text & ~F.col("t").rlike(PLAIN_NUMBER)
    day = F.concat_ws("/", *[F.regexp_extract("t", ISO_DATE, i) for i in (3, 2, 1)])
    printed = F.when(plain & iso, F.array(day)).when(plain & (F.length("t") >= MIN_TEXT), F.array("t"))
    s = F.struct("ord", "path")
    texts = rows.select(*by, F.explode(F.coalesce(dates, printed)).alias("printed"), s.alias("s")).groupBy(*by, "printed").agg(F.min("s").alias("s"))
    nums = rows.withColumn("number", number).where(F.col("number").isNotNull()).groupBy(*by, "number").agg(F.min(s).alias("s"))
    return texts.select(*by, "printed", F.lit(None).cast(NUMBER_TYPE).alias("number"), F.col("s.path").alias("path")).unionByName(
        nums.select(*by, F.lit(None).cast("string").alias("printed"), "number", F.col("s.path").alias("path")))


def dictionary(cells: DataFrame) -> DataFrame:
    """value_dictionary(name, number, text_lc) of workbook cells (sheet, row, col, kind, value).

    The first row with text heads the columns; in a row the last text on the left labels the
    next cells. A row is the window; the first entry of a text wins.
    """
    c = cells.where(F.col("value") != "")
    first = c.groupBy("sheet").agg(F.min("row").alias("_h"))
    c = c.join(first, "sheet")
    heads = c.where((F.col("row") == F.col("_h")) & (F.col("kind") == "text")).select("sheet", "col", F.col("value").alias("head"))
    body = c.where((F.col("row") > F.col("_h")) | (F.col("kind") != "text"))
    w = Window.partitionBy("sheet", "row").orderBy("col").rowsBetween(Window.unboundedPreceding, -1)
    short = (F.col("kind") == "text") & (F.length("value") <= MAX_CELL)
    body = body.withColumn("label", F.last(F.when(short, F.col("value")), ignorenulls=True).over(w))
    body = body.join(heads, ["sheet", "col"], "left").withColumn(
        "name", F.concat(F.col("sheet"), F.lit(": "), F.coalesce("label", "head", F.col("col").cast("string"))))
    nums = body.where(F.col("kind") == "number").select("name", F.col("value").try_cast(NUMBER_TYPE).alias("number"), F.lit(None).cast("string").alias("text_lc"))
    texts = body.where(short).groupBy(F.lower("value").alias("text_lc")).agg(F.min_by("name", F.struct("sheet", "row", "col")).alias("name"))
    return nums.where(F.col("number").isNotNull()).unionByName(texts.select("name", F.lit(None).cast(NUMBER_TYPE).alias("number"), "text_lc"))


def lookup(values: DataFrame, index: DataFrame, entries: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``found_name``, ``listino`` and ``proof`` to printed values.

    Three equi joins: payload text, dictionary (numbers met at each printed precision) and
    payload number.
    """
    printed = squeeze(F.col("value"))
    v = values.withColumn("_p", printed).withColumn("_c", F.regexp_replace("value", EDGE, ""))
    v = v.withColumn("_n", italian_number("_c")).withColumn("_d", printed_decimals("_c"))
    t = index.where(F.col("printed").isNotNull()).select(*by, F.col("printed").alias("_p"), F.col("path").alias("_full"))
    core = t.select(*by, F.col("_p").alias("_cs"), F.col("_full").alias("_core"))
    n = index.where(F.col("number").isNotNull()).select(*by, F.col("number").alias("_n"), F.col("path").alias("_num"))
    places = v.select("_d").distinct()
    rounded = entries.where(F.col("number").isNotNull()).join(places).select(
        F.col("_d"), F.round("number", 18).alias("number"), "name").withColumn(
        "_n", F.when(F.col("_d") == 0, F.col("number")).otherwise(
            F.expr("cast(bround(number * power(cast(10 as decimal(20,0)), _d), 0) / power(cast(10 as decimal(20,0)), _d) as decimal(38,18))")))
    rounded = rounded.groupBy("_d", "_n").agg(F.min("name").alias("_dn"))
    texts = entries.where(F.col("text_lc").isNotNull()).select(F.col("text_lc").alias("_lc"), F.col("name").alias("_dt"))
    j = (
        v.withColumn("_cs", squeeze(F.col("_c"))).withColumn("_lc", F.lower("_c"))
        .join(t, [*by, "_p"], "left").join(core, [*by, "_cs"], "left").join(rounded, ["_d", "_n"], "left")
        .join(texts, "_lc", "left").join(n, [*by, "_n"], "left"))
    entry = F.coalesce("_dn", F.when(F.col("_n").isNull(), F.col("_dt")))
    name = F.coalesce("_full", entry, F.when(F.col("_n").isNotNull(), F.col("_num")).otherwise(F.col("_core")), F.lit(""))
    listino = F.col("_full").isNull() & entry.isNotNull() & F.col("_c").rlike(r"\d")
    by_payload = F.when(F.col("_n").isNotNull(), F.col("_num").isNotNull()).otherwise(F.coalesce("_full", "_core").isNotNull())
    return j.withColumn("found_name", name).withColumn("listino", listino).withColumn(
        "proof", F.when(listino, "listino").when(by_payload, "payload")).drop(
        "_p", "_c", "_n", "_d", "_cs", "_lc", "_full", "_core", "_dn", "_dt", "_num")


def key_words(key: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.translate(key, "_-.", "   "), F.lit(KEY_WORDS), F.lit(1)), lambda w: F.lower(w))


def structural(key: Column) -> Column:
    """Plumbing, not printed data: the last or first word of the key says so."""
    w = key_words(key)
    last, first = F.try_element_at(w, F.lit(-1)), F.try_element_at(w, F.lit(1))
    return F.coalesce(last.isin(*STRUCTURAL) | ((F.size(w) > 1) & first.isin(*QUALIFIERS)), F.lit(False))


def visible_leaves(found: DataFrame, documents: DataFrame, by: list[str]) -> DataFrame:
    """Leaves printed in the document and safe to change; ``documents`` is (…, text, numbers)."""
    low = F.lower("path")
    skip = F.lit(False)
    for part in EXCLUDED_CONTROL:
        skip = skip | low.contains(part)
    segs = F.transform(F.split(F.regexp_replace("path", r"\[\d+\]", ""), r"\."), lambda s: structural(s))
    t = squeeze(F.col("value"))
    small = t.rlike(r"^[-+]?\d+(?:[.,]\d+)?$") & (F.length(F.regexp_replace(t, r"\D", "")) <= 2)
    amount = F.coalesce(F.try_element_at(key_words(F.col("name")), F.lit(-1)).isin(*PRINTED_NUMBERS), F.lit(False))
    rows = found.where(~skip & F.col("value").isNotNull() & ~F.col("kind").isin("BOOLEAN", "VOID") & ~F.exists(segs, lambda x: x))
    rows = rows.where(~F.col("value").rlike(r"^[A-Z][A-Z0-9_]*$") & (~small | amount)).join(documents, by)
    number = F.replace(t, F.lit(","), F.lit(".")).try_cast(NUMBER_TYPE)
    iso = F.concat_ws("/", *[F.regexp_extract("value", ISO_DATE, i) for i in (3, 2, 1)])
    shown = F.when(t.rlike(ISO_DATE), iso).otherwise(F.lower(t))
    phrase = F.concat(F.lit(" "), F.lower("text"), F.lit(" ")).contains(F.concat(F.lit(" "), shown, F.lit(" ")))
    seen = F.when(t.rlike(r"^[-+]?\d+(?:[.,]\d+)?$"), F.array_contains("numbers", number)).otherwise((F.length(t) >= 3) & phrase)
    return rows.where(F.coalesce(seen, F.lit(False))).drop("text", "numbers")


def perturbed(value: Column, seed: Column) -> Column:
    """Same format, other value: digits stay digits, letters letters, days move 1–27 days.

    Deterministic for (seed, position): each character is shifted by a hash, never onto itself.
    """
    def roll(i: Column, n: int) -> Column:
        return F.pmod(F.xxhash64(seed, i), F.lit(n)).cast("int")

    def digit(c: Column, prev: Column, i: Column) -> Column:
        first = (i == 0) | ~prev.rlike("[0-9]")
        d = c.try_cast("int")
        lead = F.when(d == 0, c).otherwise((1 + F.pmod(d - 1 + 1 + roll(i, 8), F.lit(9))).cast("string"))
        return F.when(first, lead).otherwise(F.pmod(d + 1 + roll(i, 9), F.lit(10)).cast("string"))

    def letter(c: Column, base: int, i: Column) -> Column:
        return F.char((F.lit(base) + F.pmod(F.ascii(c) - base + 1 + roll(i, 25), F.lit(26))).cast("bigint"))

    chars = F.split(value, "")

    def one(c: Column, i: Column) -> Column:
        prev = F.coalesce(F.get(chars, i - 1), F.lit(""))
        return F.when(c.rlike("^[0-9]$"), digit(c, prev, i)).when(c.rlike("^[a-z]$"), letter(c, 97, i)).when(
            c.rlike("^[A-Z]$"), letter(c, 65, i)).otherwise(c)

    days = 1 + F.pmod(F.xxhash64(seed), F.lit(27)).cast("int")
    iso = F.regexp_extract(value, ISO_DATE, 0) != ""
    moved = F.concat(F.date_add(F.try_to_date(F.left(value, F.lit(10)), "yyyy-MM-dd"), days).cast("string"), F.substr(value, F.lit(11)))
    it = value.rlike(r"^\d{2}/\d{2}/\d{4}$")
    moved_it = F.date_format(F.date_add(F.try_to_date(value, "dd/MM/yyyy"), days), "dd/MM/yyyy")
    epoch = value.rlike(EPOCH_MILLIS)
    moved_ms = (value.try_cast("bigint") + days * F.lit(86_400_000)).cast("string")
    return F.when(iso, moved).when(it, moved_it).when(epoch, moved_ms).otherwise(F.array_join(F.transform(chars, one), ""))


def leaf_subsets(found: DataFrame, by: list[str], levels: int | None = None, calls: int | None = None) -> DataFrame:
    """(…, path, level, part): all leaves, halves, quarters… down to single leaves, breadth first.

    ``calls`` bounds the number of groups, ``levels`` that of the levels; without them everything is split.
    """
    if levels is None:
        most = found.groupBy(*by).count().agg(F.max("count")).first()[0] or 1
        levels = 1 + (int(most) - 1).bit_length()
    w = Window.partitionBy(*by).orderBy("ord")
    r = found.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    out = r.withColumn("_lo", F.lit(0)).withColumn("_hi", F.col("_n").cast("int")).withColumn("level", F.lit(0)).withColumn("part", F.lit(0))
    every = out
    for level in range(1, levels):
        mid = F.col("_lo") + F.floor((F.col("_hi") - F.col("_lo") + 1) / 2).cast("int")
        split = out.where(F.col("_hi") - F.col("_lo") > 1).withColumn("_mid", mid)
        out = split.withColumn("part", F.col("part") * 2 + F.when(F.col("_i") < F.col("_mid"), 0).otherwise(1)).withColumn(
            "_nlo", F.when(F.col("_i") < F.col("_mid"), F.col("_lo")).otherwise(F.col("_mid"))).withColumn(
            "_hi", F.when(F.col("_i") < F.col("_mid"), F.col("_mid")).otherwise(F.col("_hi"))).withColumn("_lo", F.col("_nlo")).drop(
            "_nlo", "_mid").withColumn("level", F.lit(level))
        every = every.unionByName(out)
    every = every.drop("_i", "_n", "_lo", "_hi")
    if calls is None:
        return every
    rank = F.dense_rank().over(Window.partitionBy(*by).orderBy("level", "part"))
    return every.withColumn("_g", rank).where(F.col("_g") <= calls).drop("_g")


def structure_changed(diffs: DataFrame, comparisons: DataFrame) -> DataFrame:
    s = diffs.groupBy("pair_id").agg(F.bool_or(F.col("op").isin(*SECTION_OPS)).alias("_s"))
    return comparisons.join(s, "pair_id", "left").select(
        "pair_id", ((F.col("left_pages") != F.col("right_pages")) | F.coalesce("_s", F.lit(False))).alias("structure_changed"))


def changed_words(diffs: DataFrame) -> DataFrame:
    """Distinct left words of text differences (style, spacing and moves left out)."""
    keep = F.col("klass").isin("testo", "zona", "variabile", "rumore", "arredo", "composizione") & (F.col("op") != "spostato")
    return diffs.where(keep).select("pair_id", F.explode("left_keys").alias("word")).distinct()


def proven_words(values: DataFrame, words: DataFrame) -> DataFrame:
    """Places where a whole printed value stands in the words of its pair: (pair_id, value, start, n).

    Every token of a value meets the words on (pair, token); a word ``k`` places into the value votes for the start
    ``k`` places before it, and a start with a vote of each token is a place of the value, however long it is.
    """
    v = values.select("pair_id", "value").distinct().withColumn("tokens", F.split(squeeze(F.col("value")), " ")).withColumn("n", F.size("tokens"))
    tokens = v.select("pair_id", "value", "n", F.posexplode("tokens").alias("k", "key"))
    votes = tokens.join(words.select("pair_id", "pos", "key"), ["pair_id", "key"]).withColumn("start", F.col("pos") - F.col("k"))
    return votes.groupBy("pair_id", "value", "start", "n").agg(F.count("*").alias("_votes")).where(F.col("_votes") == F.col("n")).drop("_votes")


def carry_words(proven: DataFrame, anchors: DataFrame) -> DataFrame:
    """Proven word positions carried to the other document through its anchors (pair_id, i, j)."""
    return proven.join(anchors, (proven["pair_id"] == anchors["pair_id"]) & (proven["start"] == anchors["i"])).select(
        proven["pair_id"], "value", F.col("j").alias("start"), "n")
