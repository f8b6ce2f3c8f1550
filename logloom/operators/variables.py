"""The variables pass: differences that are, or hold, a proven value become variables; what is left of them goes on counting.

A value is proven by its place (a hole, a cell, a placeholder, a heading over an empty band) together with its text (a
payload leaf, a dictionary entry, a control execution). Proofs are tables; a difference meets its own by an equi join on (pair_id, id),
and is cut by the ranges found in it as columns of its row: covered keys go to the variable, the remainder stays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_conditional, is_placeholder
from .layout import UNITS, value_runs

# The proofs that name a value by its text, the mark of a value's place in an anchor, kinds that are never values.
VALUE_PROOFS, HOLE, NEVER = ("listino", "esecuzione"), "⎵", ("maiuscole", "punteggiatura", "spazi")
ALL_PROOFS = ("segnaposto", "buco", "cella", "sezione", "listino", "esecuzione")
KEY = ["pair_id", "id"]
CUTS = "array<struct<s:int,e:int,prova:string,nome:string>>"


def runs_of_differences(diffs: DataFrame) -> DataFrame:
    """(pair_id, id, s, e, value): the value runs in the generated keys of differences."""
    t = diffs.select(F.struct(*KEY).alias("doc"), F.posexplode("right_keys").alias("pos", "text"))
    return value_runs(t).select("doc.pair_id", "doc.id", F.col("start").cast("int").alias("s"), (F.col("end") + 1).cast("int").alias("e"), "value")


def proven_values(runs: DataFrame, sites: DataFrame, sources: DataFrame, fixed: DataFrame) -> DataFrame:
    """(pair_id, id, s, e, prova, nome): runs with both proofs, the first of each place.

    ``sites`` (pair_id, id, s, prova, room): the place where a run begins is a hole or a cell; ``room`` names it, as a room holds one
    value. ``sources`` (pair_id, value, source, nome): texts that are values. ``fixed`` (pair_id, value): texts the target
    prints elsewhere are none.
    """
    best = sources.groupBy("pair_id", "value").agg(F.min(F.struct("source", "nome")).alias("_s"))
    j = runs.join(sites.select(*KEY, "s", F.col("prova").alias("_site"), "room"), [*KEY, "s"]).join(best, ["pair_id", "value"])
    j = j.join(fixed.select("pair_id", "value").distinct(), ["pair_id", "value"], "left_anti")
    prova = F.when(F.col("_s.source").isin(*VALUE_PROOFS), F.col("_s.source")).otherwise(F.col("_site"))
    row = F.struct("s", "e", prova.alias("prova"), F.col("_s.nome").alias("nome"))
    return j.groupBy(*KEY, "room").agg(F.min(row).alias("v")).select(*KEY, "v.*")


def _op(left: Column, right: Column) -> Column:
    return F.when(F.size(right) == 0, "mancante").when(F.size(left) == 0, "in_piu").otherwise("cambiato")


def _uncovered(keys: Column, cuts: Column) -> Column:
    return F.filter(keys, lambda _k, i: ~F.exists(cuts, lambda c: (i >= c["s"]) & (i < c["e"])))


def _covered(keys: Column, cuts: Column) -> Column:
    return F.filter(keys, lambda _k, i: F.exists(cuts, lambda c: (i >= c["s"]) & (i < c["e"])))


def split_at_values(diffs: DataFrame, values: DataFrame, on: Sequence[str] = ALL_PROOFS) -> DataFrame:
    """Differences cut at their proven values: the remainder as it counted, then the variable.

    ``diffs`` needs pair_id, id, op, klass, left_keys, right_keys, target_text, prova, nome; ``values`` (pair_id, id, s, e, prova, nome)
    are ranges of the generated keys. Of ranges that overlap the first counts. A difference that is nothing but values is a variable
    whole. A proof that is switched off cuts nothing; if it is the only one, the difference keeps its class and carries the proof.
    Adds ``part``: 0 for what stands in the difference's place, 1 for a variable split off.
    """
    ordered = F.array_sort(F.collect_list(F.struct("s", "e", "prova", "nome")))
    g = values.groupBy(*KEY).agg(ordered.cast(CUTS).alias("_all"))
    apart = F.reduce("_all", F.expr(f"cast(array() as {CUTS})"), lambda acc, x: F.when(
        F.exists(acc, lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"])), acc).otherwise(F.concat(acc, F.array(x))))
    g = g.withColumn("_all", apart).withColumn("_cut", F.filter("_all", lambda c: c["prova"].isin(*on)))
    j = diffs.join(g, KEY, "left")
    textual = F.col("klass").isin("testo", "zona") & F.col("op").isin("in_piu", "cambiato", "sezione_in_piu") & ~F.col("tipo").isin(*NEVER)
    hit = F.coalesce(textual & (F.size("_all") > 0), F.lit(False))
    j = j.withColumn("_all", F.when(hit, F.col("_all"))).withColumn("_cut", F.when(hit, F.col("_cut")))
    keep, cut = diffs.columns, F.coalesce(F.size("_cut") > 0, F.lit(False))
    first = lambda c: F.get(c, F.lit(0))
    same = j.where(~cut).withColumn("prova", F.coalesce(first("_all")["prova"], "prova")).withColumn("nome", F.coalesce(first("_all")["nome"], "nome"))
    c = j.where(cut).withColumn("_rest", _uncovered(F.col("right_keys"), F.col("_cut"))).withColumn("_value", _covered(F.col("right_keys"), F.col("_cut")))
    whole = (F.size("left_keys") == 0) & (F.size("_rest") == 0)
    variable = c.withColumn("right_keys", F.col("_value")).withColumn("left_keys", F.when(whole, F.col("left_keys")).otherwise(F.array().cast("array<string>")))
    variable = variable.withColumn("klass", F.lit("variabile")).withColumn("prova", first("_cut")["prova"]).withColumn("nome", first("_cut")["nome"]).withColumn(
        "target_text", F.when(whole, F.col("target_text")).otherwise(F.trim(F.concat_ws(" ", "target_text", F.lit(HOLE))))).withColumn(
        "part", F.when(whole, 0).otherwise(1))
    rest = c.where(~whole).withColumn("right_keys", F.col("_rest")).withColumn("part", F.lit(0))
    cut_rows = variable.unionByName(rest).withColumn("op", F.when(F.col("op") == "sezione_in_piu", F.col("op")).otherwise(_op(F.col("left_keys"), F.col("right_keys"))))
    return same.select(*keep, F.lit(0).alias("part")).unionByName(cut_rows.select(*keep, "part"))


def _as_variable(diffs: DataFrame, test: Column, prova: str | Column, nome: Column, on: Sequence[str]) -> DataFrame:
    """Rows where ``test`` holds carry the proof; they become variables unless it is switched off."""
    prova = F.lit(prova) if isinstance(prova, str) else prova
    test = F.coalesce(test, F.lit(False))
    return diffs.withColumn("_on", test & prova.isin(*on)).withColumn("prova", F.when(test, prova).otherwise(F.col("prova"))).withColumn(
        "nome", F.when(test, F.coalesce(nome, F.lit(""))).otherwise(F.col("nome"))).withColumn(
        "klass", F.when(F.col("_on"), "variabile").otherwise(F.col("klass"))).drop("_on")


def _stripped(text: Column) -> Column:
    """The inside of an outermost ``{{…}}`` without inner pairs."""
    return F.regexp_replace(F.expr("substring(_t, 3, length(_t) - 4)"), r"\{\{[^{}]*\}\}", "")


def missing_texts(diffs: DataFrame, on: Sequence[str] = ALL_PROOFS) -> DataFrame:
    """A target text left out that is one conditional ``{{…}}``, or placeholders only, is a variable."""
    d = diffs.withColumn("_t", F.trim(F.array_join("left_keys", " ")))
    braces = F.col("_t").rlike(r"(?s)^\{\{.*\}\}$") & is_conditional(_stripped(F.col("_t")))
    owned = lambda k: is_placeholder(k) & ~k.rlike(r"[._…]{4,}") & ~k.contains("{{")
    test = (F.col("op") == "mancante") & F.col("klass").isin("testo", "zona") & ~F.col("tipo").isin(*NEVER) & (
        braces | ((F.size("left_keys") > 0) & F.forall("left_keys", owned)))
    return _as_variable(d, test, "segnaposto", F.col("_t"), on).drop("_t")


def section_values(diffs: DataFrame, voids: DataFrame, sources: DataFrame, fixed: DataFrame, on: Sequence[str] = ALL_PROOFS) -> DataFrame:
    """An added text under a heading over an empty band (``voids``: pair_id, id), known as a value, is a variable whole."""
    best = sources.groupBy("pair_id", F.col("value").alias("_v")).agg(F.min(F.struct("source", "nome")).alias("_s"))
    d = diffs.withColumn("_v", F.array_join("right_keys", " "))
    d = d.join(voids.select(*KEY).distinct().withColumn("_void", F.lit(True)), KEY, "left").join(best, ["pair_id", "_v"], "left").join(
        fixed.select("pair_id", F.col("value").alias("_v")).distinct().withColumn("_fixed", F.lit(True)), ["pair_id", "_v"], "left")
    added = (F.col("op") == "in_piu") & F.col("klass").isin("testo", "zona") & ~F.col("tipo").isin(*NEVER)
    section = (F.col("op") == "sezione_in_piu") & (F.col("klass") == "composizione")
    test = (added | section) & F.col("_void") & F.col("_s").isNotNull() & F.col("_fixed").isNull()
    return _as_variable(d, test, "sezione", F.col("_s.nome"), on).drop("_v", "_void", "_s", "_fixed")


def slot_values(diffs: DataFrame, runs: DataFrame, fixed: DataFrame, names: DataFrame, on: Sequence[str] = ALL_PROOFS) -> DataFrame:
    """What slots took (class ``variabile`` already): declared ones are values, probable ones are cut to their first value run.

    ``diffs`` also needs ``slot`` (certo, probabile, or null for no slot). ``names`` (pair_id, value, nome). A switched-off proof
    gives the difference a counting class again.
    """
    free = runs.join(fixed.select("pair_id", "value").distinct(), ["pair_id", "value"], "left_anti").groupBy(*KEY).agg(F.min(F.struct("s", "e", "value")).alias("_r"))
    d = diffs.withColumn("part", F.lit(0)).withColumn("_text", F.array_join("right_keys", " ")).join(free, KEY, "left")
    named = names.groupBy("pair_id", "value").agg(F.min("nome").alias("_nome"))
    slot = F.col("slot").isNotNull() & (F.col("klass") == "variabile")
    marked = (F.col("slot") == "certo") | F.exists("left_keys", is_placeholder)
    d = d.withColumn("_slot", F.coalesce(slot, F.lit(False))).withColumn("_marked", F.coalesce(marked, F.lit(False)))
    d = d.withColumn("value", F.when(F.col("_marked"), F.col("_text")).otherwise(F.coalesce("_r.value", "_text")))
    d = d.join(named, ["pair_id", "value"], "left").drop("value")
    prova = F.when(F.col("_marked"), "segnaposto").otherwise("buco")
    off = F.col("_slot") & ~prova.isin(*on)
    open_ = F.col("_slot") & ~off & ~F.col("_marked")
    cuts = F.when(F.col("_r").isNotNull(), F.array(F.struct(F.col("_r.s").alias("s"), F.col("_r.e").alias("e")))).otherwise(
        F.expr("cast(array() as array<struct<s:int,e:int>>)"))
    d = d.withColumn("_rest", _uncovered(F.col("right_keys"), cuts))
    keep = [*diffs.columns, "part"]
    nome = F.coalesce("_nome", F.lit(""))
    d = d.withColumn("_way", F.when(~F.col("_slot"), "same").when(off, "off").when(~open_, "value").when(F.col("_r").isNull(), "free").when(
        F.size("_rest") == 0, "value").otherwise("cut"))
    way = lambda name: d.where(F.col("_way") == name)
    counting = F.when(F.col("zone").isNull() | (F.col("zone") == "corpo"), "testo").otherwise("zona")
    plain = lambda x: x.withColumn("klass", counting).withColumn("op", _op(F.col("left_keys"), F.col("right_keys")))
    proven = lambda x: x.withColumn("prova", prova).withColumn("nome", nome)
    none = F.array().cast("array<string>")
    rest = plain(way("cut").withColumn("right_keys", F.col("_rest")).withColumn("left_keys", none)).withColumn("prova", F.lit("")).withColumn("nome", F.lit(""))
    value = proven(way("cut").withColumn("right_keys", _covered(F.col("right_keys"), cuts)).withColumn("left_keys", none)).withColumn(
        "target_text", F.trim(F.concat_ws(" ", "target_text", F.lit(HOLE)))).withColumn("part", F.lit(1)).withColumn("op", F.lit("in_piu"))
    free_text = plain(way("free").withColumn("left_keys", none)).withColumn("prova", F.lit("")).withColumn("nome", F.lit(""))
    parts = [way("same"), proven(way("off")).withColumn("klass", counting), proven(way("value")), free_text, rest, value]
    out = parts[0].select(*keep)
    for p in parts[1:]:
        out = out.unionByName(p.select(*keep))
    return out


def lone_units(diffs: DataFrame, cells: DataFrame, on: Sequence[str] = ALL_PROOFS) -> DataFrame:
    """A target unit left out (``euro``) in a cell that a value with that unit filled is part of the value.

    ``cells`` (pair_id, id, filled, nome): the cell in which a difference's target words stand, and the text that filled it.
    """
    c = cells.groupBy(*KEY).agg(F.min(F.struct("filled", "nome")).alias("_c"))
    d = diffs.join(c, KEY, "left")
    unit = (F.size("left_keys") > 0) & F.forall("left_keys", lambda k: F.lower(k).isin(*UNITS))
    test = (F.col("op") == "mancante") & F.col("klass").isin("testo", "zona") & unit & F.col("_c.filled").contains(F.array_join("left_keys", " "))
    return _as_variable(d, test, "cella", F.col("_c.nome"), on).drop("_c")


def recognise_variables(diffs: DataFrame, sites: DataFrame, sources: DataFrame, fixed: DataFrame, voids: DataFrame, cells: DataFrame,
                        on: Sequence[str] = ALL_PROOFS) -> DataFrame:
    """All of the pass, one rule after the other; a difference that is a variable already meets the slot rule only.

    ``diffs`` (pair_id, id, op, klass, tipo, zone, slot, left_keys, right_keys, target_text); adds prova, nome and part, and
    ``number``: 1… per pair in the order of (id, part).
    """
    d = diffs.withColumn("prova", F.lit("")).withColumn("nome", F.lit(""))
    runs = runs_of_differences(diffs)
    names = sources.select("pair_id", "value", "nome")
    d = section_values(missing_texts(d, on), voids, sources, fixed, on)
    slots = d.where("slot IS NOT NULL")
    rest = split_at_values(d.where("slot IS NULL"), proven_values(runs, sites, sources, fixed), on)
    every = lone_units(rest.unionByName(slot_values(slots, runs, fixed, names, on)), cells, on)
    w = Window.partitionBy("pair_id").orderBy("id", "part")
    return every.withColumn("number", F.row_number().over(w))
