"""Networks in three passes, Egyptian, Demotic, Coptic, each of which reads and extends what the passes before it left.

This is the older builder. A node is named by what it is (language, form, period, dialect, hieroglyphs, etymology), so its id is the same
in every network and every pass, and one node may stand in many networks. A pass makes candidates, each with the moment (a struct of
places) at which the older, sequential builder would have made it; what that builder finds by looking around is then settled for all rows at once:

* a candidate that is *known* takes the values of the first network that holds its id (by the networks' moments, then the node's);
* a candidate by *form* takes the id of the first node of that language and form, whatever its etymology;
* a network keeps the first candidate of an id, and an edge made *once* only if no earlier one has the same ends.

Since networks of earlier lemmas are finished when a later one looks around, the first holder is the minimum over all candidates, and no
loop over lemmas is needed: a grouped minimum and a join for each kind, whatever the number of lemmas.

senses: as in operators.networks; lemma_ord is the order within a language.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from glyphweave.functions import lexical as lx
from glyphweave.functions.tables import NO_DATE, OTHER_DATE
from glyphweave.operators import graph as g
from glyphweave.operators.components import connected_components
from glyphweave.session import cut

PASSES = ("egy", "dem", "cop")
VALUES = ("language", "form", "transliteration", "hieroglyphs", "part_of_speech", "meanings", "period", "dialect", "etymology_index")
EDGE = ("network_id", "moment", "from", "to", "type", "notes", "target_language", "etymology_snippet", "dialect")
#: Moments of what comes before the forms' groups, and after all definitions.
BEFORE, LAST_DEF = -1, 2**31 - 1
# Templates of affixes, and the notes that edges bear; what they name comes in between or after.
AFFIXES = ("prefix", "suffix", "affix", "af", "confix")
FIRST, EVOLVED, TO = "First attestation in ", "Evolution from ", " to "
GLYPHS, SPELLING = "Hieroglyphic variant", "Spelling variant"
ALTERNATIVE, TOLD = "Alternative form of ", " (from definition)"
PART_OF_COMPOUND, OLD_PART, COPTIC_PART = "compound component: ", "Egyptian component of Demotic compound", "Component of compound"
DERIVED, AFFIXED, STEM = "Derived from ", "Affixed with ", "Coptic base word from "
_text = lambda v=None: F.lit(v).cast("string")
_none = lambda: F.array().cast("array<string>")


class Passes(NamedTuple):
    """networks: network_id, made, root (the first node), root_language, root_etymology_index, has_demotic_descendant. spoken: ids (id, said) that no node need have."""

    networks: DataFrame
    nodes: DataFrame
    edges: DataFrame
    spoken: DataFrame


def node_id(language, form, period=None, dialect=None, hieroglyphs=None, etymology=None) -> Column:
    """The natural key: equal ids, equal nodes, in any network and pass."""
    part = lambda c: F.coalesce((c if isinstance(c, Column) else _text(c)).cast("string"), F.lit(""))
    return F.concat_ws("\u001f", *map(part, (language, form, period, dialect, hieroglyphs, etymology)))


def _moment(step: int, i=0, j=0, group=BEFORE, definition: Column | None = None) -> Column:
    whole = lambda c: (c if isinstance(c, Column) else F.lit(c)).cast("long")
    places = {"pass": F.col("pass"), "lemma": F.col("lemma_ord"), "etym": F.col("etym_idx"), "def": F.col("def_idx") if definition is None else definition, "group": group, "step": step, "i": i, "j": j}
    return F.struct(*[whole(c).alias(k) for k, c in places.items()])


def _node(moment: Column, id_: Column, language, form: Column, how: str = "own", said: Column | None = None, **more: Column) -> list[Column]:
    """A candidate. said: when its id was first spoken of, if earlier."""
    base = {"language": language if isinstance(language, Column) else F.lit(language), "form": form, "transliteration": _text(), "hieroglyphs": _text(), "part_of_speech": F.coalesce(F.col("part_of_speech"), F.lit("unknown")), "meanings": _none(), "period": _text(), "dialect": _text(), "etymology_index": F.lit(None).cast("int")} | more
    return [F.col("network_id"), moment.alias("moment"), id_.alias("id"), *[base[c].alias(c) for c in VALUES], F.lit(how).alias("how"), (moment if said is None else said).alias("said")]


def _edge(moment: Column, a: Column, b: Column, kind, notes=None, once: bool = False, target: Column | None = None, snippet: Column | None = None, dialect: Column | None = None, by_form: str | None = None) -> list[Column]:
    lit = lambda x: x if isinstance(x, Column) else _text(x)
    return [F.col("network_id"), moment.alias("moment"), a.alias("from"), b.alias("to"), lit(kind).alias("type"), lit(notes).alias("notes"), lit(target).alias("target_language"), lit(snippet).alias("etymology_snippet"), lit(dialect).alias("dialect"), F.lit(once).alias("once"), _text(by_form).alias("by_form")]


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _rows(senses: DataFrame, language: str) -> DataFrame:
    """A language's definitions with their own id (own) and what they are an alternative form of (target)."""
    rows = senses.where(F.col("language") == language)
    if language == "dem":  # an etymology without definitions still has a node
        rows = rows.withColumns({"def_idx": F.coalesce("def_idx", F.lit(0)), "part_of_speech": F.coalesce("part_of_speech", F.lit("unknown"))})
    rows = rows.where("def_idx is not null").withColumns({"pass": F.lit(PASSES.index(language)), "meanings": F.coalesce("meanings", _none()), "own": node_id(language, F.col("lemma"), etymology=F.col("etym_idx"))})
    return rows.withColumns({"network_id": F.col("own"), "target": lx.alternative_target(F.col("meanings"))})


def _full(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def _forms(rows: DataFrame) -> DataFrame:
    """The main form (i = 0) and the alternative ones of each definition, grouped by inflection: grp 0 is the base, others by their first form."""
    key = ("pass", "lemma_ord", "etym_idx", "def_idx")
    alternatives = F.coalesce("alternative_forms", F.array())
    each = rows.select(*key, "lemma", "own", "part_of_speech", "meanings", F.posexplode(alternatives).alias("at", "a"))
    period = lx.period(F.col("a.date"), older=True)
    spelled = F.coalesce(_full("a.transliteration"), _full("a.form"), F.col("lemma"))
    told = F.lower(F.concat_ws(" ", F.coalesce("a.title", F.lit("")), F.coalesce("a.note", F.lit(""))))
    kind = F.when(told.contains("plural") | told.contains("pl."), "plural").when(told.contains("dual"), "dual").when(told.contains("feminine") | told.contains("fem."), "feminine").otherwise("base")
    each = each.select(*key, "lemma", "own", "part_of_speech", "meanings", (F.col("at") + 1).alias("i"), spelled.alias("form"), period.alias("period"), lx.period_rank(period, older=True).alias("rank"), F.col("a.hieroglyphs").alias("hieroglyphs"), kind.alias("kind"), F.nullif(F.regexp_extract("a.title", r"\{\{m-self\|egy\|[^|]+\|([^}]+)\}\}", 1), F.lit("")).alias("named"))
    base = F.when(F.col("kind") == "base", F.lit("")).when(F.col("kind") == "plural", F.coalesce("named", "form")).otherwise(F.col("form"))
    each = each.withColumns({"base": base, "id": node_id("egy", F.col("form"), F.col("period"), None, F.col("hieroglyphs"), F.col("etym_idx"))}).drop("named")
    main = rows.select(*key, "lemma", "own", "part_of_speech", "meanings", F.lit(0).alias("i"), F.col("lemma").alias("form"), _text().alias("period"), F.lit(NO_DATE).alias("rank"), _text().alias("hieroglyphs"), F.lit("base").alias("kind"), F.lit("").alias("base"), F.col("own").alias("id"))
    both = main.unionByName(each)
    both = both.withColumn("grp", F.min("i").over(Window.partitionBy(*key, "kind", "base")))
    return both.withColumn("network_id", F.when(F.col("grp") == 0, F.col("own")).otherwise(node_id("egy", F.col("base"), None, F.col("kind"), None, F.col("etym_idx"))))


def _form_edges(forms: DataFrame) -> DataFrame:
    """First attestation, a form of one period to the first of the next, and variants of one period: by glyphs, and by spelling from the most frequent one."""
    key = ("pass", "lemma_ord", "etym_idx", "def_idx", "grp", "network_id")
    ranks = forms.groupBy(*key, "rank").agg(F.min("i").alias("first_i"), F.min_by(F.struct("id", "period"), "i").alias("first"))
    by_rank = Window.partitionBy(*key).orderBy("rank")
    dated = ranks.where(F.col("rank") < OTHER_DATE).withColumns({"next": F.lead("first").over(by_rank), "n": F.row_number().over(by_rank)})
    moment = lambda step, i=0, j=0: _moment(step, i, j, F.col("grp"))
    undated = ranks.where(F.col("rank") == NO_DATE).select(*key, F.col("first.id").alias("root"))
    starts = dated.where("n = 1").join(undated, list(key)).select(*_edge(moment(1), F.col("root"), F.col("first.id"), "DESCENDS", F.concat(F.lit(FIRST), F.coalesce("first.period", F.lit("dated period")))))
    steps = forms.join(dated.where("next is not null").select(*key, "rank", "next", "n"), [*key, "rank"])
    steps = steps.select(*_edge(moment(2, F.col("n"), F.col("i")), F.col("id"), F.col("next.id"), "EVOLVES", F.concat(F.lit(EVOLVED), F.coalesce("period", F.lit("?")), F.lit(TO), F.coalesce("next.period", F.lit("?")))))
    same = Window.partitionBy(*key, "rank", "form")
    here = Window.partitionBy(*key, "rank")
    wide = forms.withColumns({"n": F.count("*").over(same), "lead_i": F.min("i").over(same), "lead": F.first("id").over(same.orderBy("i"))})
    most = F.first("id").over(here.orderBy(F.desc("n"), "lead_i", "i"))
    wide = wide.withColumns({"first_i": F.min("i").over(here), "most": most, "most_form": F.first("form").over(here.orderBy(F.desc("n"), "lead_i", "i"))})
    when = F.concat(F.lit(" ("), F.coalesce(_full("period"), F.lit("undated")), F.lit(")"))
    glyphs = wide.where("i > lead_i and id <> lead").select(*_edge(moment(3, F.col("first_i"), F.col("lead_i") * 1000 + F.col("i")), F.col("lead"), F.col("id"), "VARIANT", F.concat(F.lit(GLYPHS), when)))
    spellings = wide.where("i = lead_i and form <> most_form and id <> most").select(*_edge(moment(3, F.col("first_i"), F.col("i") + 10**6), F.col("most"), F.col("id"), "VARIANT", F.concat(F.lit(SPELLING), when)))
    return _all([starts, steps, glyphs, spellings])


def egyptian(senses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The first pass: (candidate nodes, candidate edges, further mentions of ids)."""
    all_ = cut(_rows(senses, "egy"))
    other = all_.where("target is not null").withColumn("network_id", node_id("egy", F.col("target"), etymology=F.col("etym_idx")))
    named = lambda i: F.concat(F.lit(ALTERNATIVE), F.col(i))
    mine = {"meanings": F.col("meanings"), "etymology_index": F.col("etym_idx")}
    nodes = [other.select(*_node(_moment(0, 0), F.col("network_id"), "egy", F.col("target"))), other.select(*_node(_moment(0, 1), F.col("own"), "egy", F.col("lemma"), **mine))]
    edges = [other.select(*_edge(_moment(0, 2), F.col("network_id"), F.col("own"), "VARIANT", named("target"), once=True))]

    rows = all_.where("target is null")
    forms = cut(_forms(rows))
    alt = F.col("i") > 0
    nodes.append(forms.select(*_node(_moment(0, F.col("i"), 0, F.col("grp")), F.col("id"), "egy", F.col("form"), said=_moment(1, F.col("i")), transliteration=F.when(alt, F.col("form")), hieroglyphs=F.col("hieroglyphs"), period=F.col("period"), **mine)))
    edges.append(_form_edges(forms))

    told = rows.select("*", F.posexplode(F.filter("alternative_forms_from_definitions", lambda x: x != "")).alias("i", "variant")).drop("network_id")
    told = told.withColumn("network_id", node_id("egy", F.col("variant"), etymology=F.col("etym_idx"))).withColumn("moment", _moment(2, F.col("i")))
    made = _all([n.select("network_id", "moment") for n in nodes]).groupBy("network_id").agg(F.min("moment").alias("made"))
    into = told.join(made, "network_id").where("made < moment").drop("moment", "made")
    nodes.append(into.select(*_node(_moment(2, F.col("i")), F.col("own"), "egy", F.col("lemma"), **mine)))
    edges.append(into.select(*_edge(_moment(2, F.col("i"), 1), F.col("network_id"), F.col("own"), "VARIANT", F.concat(named("variant"), F.lit(TOLD)), once=True)))

    dated = F.col("rank") < OTHER_DATE
    latest = forms.where(dated & (F.col("grp") == 0)).groupBy("lemma_ord", "etym_idx", "def_idx").agg(F.max_by("id", F.struct("rank", -F.col("i"))).alias("latest"))
    each = rows.join(latest, ["lemma_ord", "etym_idx", "def_idx"], "left").withColumn("parent", F.coalesce("latest", "own"))
    down = _descendants(each)
    code = F.when(F.col("d.language") == "egx-dem", "dem").otherwise(F.col("d.language"))
    nodes.append(down.select(*_node(_moment(4, F.col("i"), 0, F.lit(0)), node_id(code, F.col("d.word")), code, F.col("d.word"))))
    edges.append(down.select(*_edge(_moment(4, F.col("i"), 1, F.lit(0)), F.col("parent"), node_id(code, F.col("d.word")), "DESCENDS", target=F.col("d.language"))))

    parts = rows.select("*", F.posexplode("components").alias("i", "c")).where("c.form <> '' and c.language = 'egy'").where(F.col("c.template_type").isin(*AFFIXES, "compound"))
    compound = F.col("c.template_type") == "compound"
    at = lambda j: _moment(5, F.col("i"), j, F.lit(0))
    part = node_id("egy", F.col("c.form"))
    nodes.append(parts.select(*_node(at(0), part, "egy", F.col("c.form"), part_of_speech=F.when(compound, "word").otherwise("morpheme"))))
    edges.append(parts.select(*_edge(at(1), part, F.col("own"), "COMPONENT", F.when(compound, F.concat(F.lit(PART_OF_COMPOUND), F.col("c.form"))).otherwise(F.concat(F.coalesce("c.role", F.lit("base")), F.lit(": "), F.col("c.form"))), once=True)))
    said = told.select(F.col("network_id").alias("id"), F.col("moment").alias("said"))
    return _all(nodes), _all(edges), said


def _descendants(rows: DataFrame) -> DataFrame:
    """Descendants of the first level, the only one that the passes read: i and d."""
    top = F.filter("descendants", lambda d: d["parent_ord"].isNull() & (d["language"] != "") & (d["word"] != ""))
    return rows.select("*", F.posexplode(top).alias("i", "d"))


def demotic(senses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The second pass: own networks, the Egyptian ancestor as it is known, Coptic descendants."""
    rows = cut(_rows(senses, "dem").withColumn("ancestor", lx.older_ancestor(F.col("etymology_text"), "egx-dem")))
    nodes = [rows.select(*_node(_moment(0), F.col("own"), "dem", F.col("lemma"), meanings=F.col("meanings"), etymology_index=F.col("etym_idx")))]
    above = rows.where("ancestor.language = 'egy' and ancestor.form <> ''").withColumn("up", node_id("egy", F.col("ancestor.form")))
    nodes.append(above.select(*_node(_moment(1), F.col("up"), "egy", F.col("ancestor.form"), how="known")))
    edges = [above.select(*_edge(_moment(1, 1), F.col("up"), F.col("own"), "DESCENDS", once=True, snippet=F.substring("etymology_text", 1, 200)))]
    down = _descendants(rows)
    below = node_id(F.col("d.language"), F.col("d.word"))
    nodes.append(down.select(*_node(_moment(2, F.col("i")), below, F.col("d.language"), F.col("d.word"))))
    edges.append(down.select(*_edge(_moment(2, F.col("i"), 1), F.col("own"), below, "DESCENDS", target=F.col("d.language"))))
    return _all(nodes), _all(edges)


def coptic_ancestor(ancestors: str, text: str) -> Column:
    """(language, form): the first Demotic ancestor of the structured ones, else the first Egyptian, else the first; without a form, what the text tells."""
    of = lambda *langs: F.get(F.filter(ancestors, lambda a: a["language"].isin(*langs)), F.lit(0))
    dem, egy, any_ = of("egx-dem", "dem"), of("egy"), F.get(F.col(ancestors), F.lit(0))
    pick = F.when(dem.isNotNull(), F.struct(F.lit("egx-dem").alias("language"), dem["form"].alias("form"))).otherwise(F.struct(F.coalesce(egy["language"], any_["language"]).alias("language"), F.when(egy.isNotNull(), egy["form"]).otherwise(any_["form"]).alias("form")))
    told = lx.older_ancestor(F.col(text), "cop")
    return F.when(F.coalesce(pick["form"], F.lit("")) != "", pick).otherwise(F.struct(told["language"].alias("language"), told["form"].alias("form")))


def coptic(senses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The third pass: own networks; the word it is an alternative form of, or its ancestor, as known; dialects, derived terms, components."""
    rows = cut(_rows(senses, "cop").withColumn("ancestor", coptic_ancestor("ancestors", "etymology_text")))
    mine = {"meanings": F.col("meanings"), "etymology_index": F.col("etym_idx")}
    nodes, edges = [rows.select(*_node(_moment(0), F.col("own"), "cop", F.col("lemma"), **mine))], []
    code = F.when(F.col("ancestor.language") == "egx-dem", "dem").otherwise(F.col("ancestor.language"))
    has = F.coalesce(F.col("ancestor.form"), F.lit("")) != ""
    up = rows.withColumns({"up_lang": F.when(F.col("target").isNotNull(), "cop").otherwise(code), "up_form": F.coalesce("target", F.when(has, F.col("ancestor.form")))}).where("up_form is not null")
    above = node_id(F.col("up_lang"), F.col("up_form"))
    nodes.append(up.select(*_node(_moment(1), above, F.col("up_lang"), F.col("up_form"), how="known")))
    variant = F.col("target").isNotNull()
    edges.append(up.select(*_edge(_moment(1, 1), above, F.col("own"), F.when(variant, "VARIANT").otherwise("DESCENDS"), F.when(variant, F.concat(F.lit(ALTERNATIVE), F.col("target"))), once=True, snippet=F.when(~variant, F.substring("etymology_text", 1, 200)))))

    alt = rows.select("*", F.posexplode("alternative_forms").alias("i", "a")).where("a.form <> ''")
    key = node_id("cop", F.col("a.form"), None, F.col("a.dialect"), None, F.col("etym_idx"))
    nodes.append(alt.select(*_node(_moment(2, F.col("i")), key, "cop", F.col("a.form"), dialect=F.col("a.dialect"), **mine)))
    edges.append(alt.select(*_edge(_moment(2, F.col("i"), 1), F.col("own"), key, "VARIANT", dialect=F.col("a.dialect"))))

    told = rows.select("*", F.posexplode(F.filter("alternative_forms_from_definitions", lambda x: x != "")).alias("i", "variant"))
    key = node_id("cop", F.col("variant"), etymology=F.col("etym_idx"))
    nodes.append(told.select(*_node(_moment(3, F.col("i")), key, "cop", F.col("variant"), how="known")))
    edges.append(told.select(*_edge(_moment(3, F.col("i"), 1), key, F.col("own"), "VARIANT", F.concat(F.lit(ALTERNATIVE), F.col("variant"), F.lit(TOLD)), once=True)))

    terms = rows.select("*", F.posexplode(F.filter("derived_terms", lambda x: x != "")).alias("i", "term"))
    key = node_id("cop", F.col("term"))
    nodes.append(terms.select(*_node(_moment(4, F.col("i")), key, "cop", F.col("term"))))
    edges.append(terms.select(*_edge(_moment(4, F.col("i"), 1), F.col("own"), key, "DERIVED", F.concat(F.lit(DERIVED), F.col("lemma")))))

    # once an etymology, after its definitions
    first = rows.groupBy("pass", "lemma_ord", "etym_idx", "own", "network_id").agg(*[F.min_by(c, "def_idx").alias(c) for c in ("components", "ancestor")])
    parts = first.select("*", F.posexplode("components").alias("i", "c")).where("c.form <> ''").withColumn("lang", F.coalesce("c.language", F.lit("cop")))
    at = lambda j: _moment(0, F.col("i"), j, definition=F.lit(LAST_DEF))
    word = {"part_of_speech": F.lit("word")}
    from_dem = has & (F.col("ancestor.language") == "egx-dem")
    through = F.coalesce((F.col("lang") == "egy") & from_dem, F.lit(False))
    old = parts.where(through)
    key = node_id("egy", F.col("c.form"))
    nodes.append(old.select(*_node(at(0), key, "egy", F.col("c.form"), **word)))
    edges.append(old.select(*_edge(at(1), key, node_id("dem", F.col("ancestor.form")), "COMPONENT", OLD_PART, once=True)))
    rest = parts.where(~through)
    stems = rest.where(F.col("c.template_type").isin(*[a for a in AFFIXES if a != "af"]) & (F.coalesce("c.role", F.lit("base")) == "base"))
    key = node_id(F.col("lang"), F.col("c.form"))
    nodes.append(stems.select(*_node(at(0), key, F.col("lang"), F.col("c.form"), how="form", **word)))
    edges.append(stems.select(*_edge(at(1), key, F.col("own"), "DERIVED", F.concat(F.lit(AFFIXED), F.col("c.template_type")), by_form="from")))
    above = stems.where(has & F.col("ancestor.language").isin("egx-dem", "egy"))
    family = F.when(F.col("ancestor.language") == "egy", "Egyptian").otherwise("Demotic")
    edges.append(above.select(*_edge(at(2), node_id(F.when(F.col("ancestor.language") == "egy", "egy").otherwise("dem"), F.col("ancestor.form")), key, "DESCENDS", F.concat(F.lit(STEM), family), once=True, by_form="to")))
    compounds = rest.where("c.template_type = 'compound'")
    key = node_id("cop", F.col("c.form"))
    nodes.append(compounds.select(*_node(at(0), key, "cop", F.col("c.form"), **word)))
    edges.append(compounds.select(*_edge(at(1), key, F.col("own"), "COMPONENT", COPTIC_PART)))
    return _all(nodes), _all(edges)


def extend(known: DataFrame | None, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One pass's candidates settled against the nodes that are known from earlier passes: (nodes, edges) of this pass. known has made, the moment of its network."""
    made = nodes.groupBy("network_id").agg(F.min("moment").alias("made"))
    nodes = cut(nodes.join(made, "network_id"))
    order = F.struct("made", "moment")
    earlier = known.select("made", "moment", "id", *VALUES) if known is not None else None
    with_known = lambda df: df if earlier is None else df.unionByName(earlier)
    asked = nodes.where("how = 'form'").select("language", "form").distinct()
    holders = with_known(nodes.select("made", "moment", "id", *VALUES)).join(asked, ["language", "form"], "left_semi")
    by_form = holders.groupBy("language", "form").agg(F.min_by("id", order).alias("holder"))
    by_form = cut(by_form.select("language", "form", node_id(F.col("language"), F.col("form")).alias("asked"), "holder"))
    nodes = nodes.join(by_form.drop("asked"), ["language", "form"], "left").withColumn("id", F.when(F.col("how") == "form", F.col("holder")).otherwise(F.col("id"))).drop("holder")
    for end in ("from", "to"):
        here = by_form.select(F.col("asked").alias(end), F.col("holder"))
        edges = edges.join(here, end, "left").withColumn(end, F.when(F.col("by_form") == end, F.coalesce("holder", end)).otherwise(F.col(end))).drop("holder")
    looked = nodes.where("how <> 'own'").select("id").distinct()
    first = with_known(nodes.select("made", "moment", "id", *VALUES)).join(looked, "id", "left_semi").groupBy("id").agg(F.min_by(F.struct(*VALUES), order).alias("first"))
    filled = nodes.join(first, "id", "left").select("network_id", "made", "moment", "id", "said", *[F.when(F.col("how") == "own", F.col(c)).otherwise(F.col(f"first.{c}")).alias(c) for c in VALUES])
    rest = [c for c in filled.columns if c not in ("network_id", "id")]
    kept = filled.groupBy("network_id", "id").agg(F.min_by(F.struct(*[c for c in rest if c != "said"]), "moment").alias("x"), F.min("said").alias("said"))
    again = F.row_number().over(Window.partitionBy("network_id", "from", "to").orderBy("moment")) > 1
    return cut(kept.select("network_id", "id", "x.*", "said")), cut(edges.withColumn("again", again).where("not (once and again)").select(*EDGE))


def build_passes(senses: DataFrame) -> Passes:
    """After the three passes, before anything is merged or rerouted. Ids of nodes and networks are natural, numbered() gives the older builder's; edges that it repeats are repeated."""
    senses = cut(senses)
    nodes, edges, said = egyptian(senses)
    done_nodes, done_edges = extend(None, nodes, edges)
    for of in (demotic, coptic):
        more_nodes, more_edges = extend(done_nodes, *of(senses))
        done_nodes, done_edges = done_nodes.unionByName(more_nodes), done_edges.unionByName(more_edges)
    root = F.min_by(F.struct("id", "language", "etymology_index"), "moment")
    down = done_edges.where("target_language = 'egx-dem' and moment.pass = 0 or type = 'DESCENDS' and moment.pass = 1 and etymology_snippet is not null").select("network_id").distinct().withColumn("has_demotic_descendant", F.lit(True))
    nets = done_nodes.groupBy("network_id").agg(F.min("made").alias("made"), root.alias("r")).join(down, "network_id", "left")
    nets = nets.select("network_id", "made", F.col("r.id").alias("root"), F.col("r.language").alias("root_language"), F.col("r.etymology_index").alias("root_etymology_index"), F.coalesce("has_demotic_descendant", F.lit(False)).alias("has_demotic_descendant"))
    return Passes(nets, done_nodes, done_edges, said)


def _chain_ends(links: DataFrame, made: DataFrame) -> DataFrame:
    """(network_id, into): where each network ends that moves (source, target, one target each): at the one that doesn't move, or in a ring at the first made."""
    parts = connected_components(links, "source", "target").withColumnRenamed("node", "network_id")
    parts = parts.join(links.select(F.col("source").alias("network_id"), F.lit(True).alias("moves")), "network_id", "left").join(made, "network_id")
    ends = parts.groupBy("component").agg(F.min_by("network_id", F.struct(F.coalesce("moves", F.lit(False)), "made")).alias("into"))
    return cut(parts.join(ends, "component").where("network_id <> into").select("network_id", "into"))


def merge_alternatives(built: Passes, with_edges: bool = True) -> Passes:
    """A network with an "Alternative form of" edge whose source also stands in another network moves into the first such network, through chains of any length.

    What is there comes first; of what moves in, nodes that are there by id and edges that are there in all columns are left out. late tells what moved.
    Without with_edges the edges are a plan that has not run, for callers that read nodes alone.
    """
    networks, nodes, edges, spoken = built
    made = networks.select("network_id", "made")
    first = edges.where("type = 'VARIANT' and notes is not null").where(F.col("notes").contains(ALTERNATIVE.strip())).select("network_id", "moment", F.col("from").alias("id"))
    holders = nodes.select("id", F.col("network_id").alias("target"), F.col("made").alias("order"))
    moves = first.join(holders, "id").where("network_id <> target").groupBy("network_id").agg(F.min_by("target", F.struct("moment", "order")).alias("target"))
    to = _chain_ends(cut(moves.select(F.col("network_id").alias("source"), "target")), made)
    moved = lambda df: df.join(to, "network_id", "left").withColumns({"late": F.col("into").isNotNull(), "network_id": F.coalesce("into", "network_id")}).drop("into")
    rest = [c for c in nodes.columns if c not in ("network_id", "id")]
    out = moved(nodes).groupBy("network_id", "id").agg(F.min_by(F.struct(*rest, "late"), F.struct("late", "moment")).alias("x")).select("network_id", "id", "x.*")
    same = Window.partitionBy(*[c for c in EDGE if c != "moment"]).orderBy("late", "moment")
    both = moved(edges).withColumn("again", F.row_number().over(same) > 1).where("not (late and again)").drop("again")
    spoken = spoken.unionByName(networks.select(F.col("network_id").alias("id"), F.col("made").alias("said")))
    return Passes(networks.join(to.select("network_id"), "network_id", "left_anti"), cut(out), cut(both) if with_edges else both, spoken)


def reroute(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """An Egyptian to Coptic edge starts at the source's first Demotic descendant if that has meanings; it goes if an edge leads from there already."""
    order = F.struct("late", "moment")
    ends = g.with_ends(edges, nodes, "language", "meanings").where("type = 'DESCENDS'")
    dem = ends.where("from_language = 'egy' and to_language in ('dem', 'egx-dem')").groupBy("network_id", "from").agg(F.min_by(F.struct(F.col("to").alias("child"), (F.size("to_meanings") > 0).alias("told")), order).alias("x"))
    jumps = ends.where("from_language = 'egy' and to_language like 'cop%'").join(dem.where("x.told").select("network_id", "from", "x.child"), ["network_id", "from"])
    jumps = cut(jumps.select("network_id", "late", "moment", "from", "to", "child"))
    led = edges.where("type = 'DESCENDS'").select("network_id", F.col("from").alias("child"), "to").distinct().withColumn("led", F.lit(True))
    nth = F.row_number().over(Window.partitionBy("network_id", "child", "to").orderBy(order))
    told = jumps.join(led, ["network_id", "child", "to"], "left").withColumn("gone", F.coalesce("led", F.lit(False)) | (nth > 1)).select("network_id", "late", "moment", "from", "to", "child", "gone")
    out = edges.join(told, ["network_id", "late", "moment", "from", "to"], "left").where("gone is null or not gone")
    return out.withColumn("from", F.coalesce("child", "from")).drop("child", "gone")


def older_networks(senses: DataFrame) -> Passes:
    """G16 whole: three passes, networks of alternative forms merged (G14), Egyptian to Coptic edges rerouted."""
    built = merge_alternatives(build_passes(senses))
    return built._replace(edges=cut(reroute(built.nodes, built.edges)))


def older_nodes(senses: DataFrame) -> DataFrame:
    """The nodes of older_networks() alone: rerouting changes edges only, and none are merged."""
    return merge_alternatives(build_passes(senses), with_edges=False).nodes


def numbered(built: Passes) -> DataFrame:
    """(id, number): L00000, L00001, ... in the order in which the ids of nodes and networks were first spoken of."""
    said = built.nodes.select("id", "said").unionByName(built.networks.select(F.col("network_id").alias("id"), F.col("made").alias("said"))).unionByName(built.spoken)
    first = said.groupBy("id").agg(F.min("said").alias("said"))
    return g.sequential_ids(first, "L", "said", "id", column="number", start=0).select("id", "number")
