"""Line dedup by a log-template tree of fixed depth.

1. Tokens that hold a digit or an @ are variable fields from the start and read as one mark.
2. Candidates. A line that min_docs documents have as it is is its own template. Any other is cut into blocks. Below 13 tokens these are one more than a template of its length may have
   variable places (2 below 7 tokens, 3 below 10, then 4), so that each template leaves one block as it is; longer lines have one block more again, so that each template leaves two as they are. A line of which no block, or no two blocks if it is long (with token count
   and place), are held by min_docs documents, other than by lines that are their own templates, is left alone; so is what only a few copies share. That needs a few hashes per line, and no tokens. A single block
   of three common words is held by chance in any large table; two blocks at a time are not. Two are sought only in lines of up to PAIRED frequent blocks, since they grow with the square; one is enough in others.
3. Tree. A candidate's path is its token count and its two leading tokens; a leading token that fewer than min_docs
   documents have below its node goes the node's wildcard way. In a leaf, a token is constant where at least
   min_docs documents have it at its place; every other place is generalised. The template is what is constant. Lines of which a third or more of the
   places are variable stay.
4. A template recurs when at least min_docs documents hold it, and these documents are unlike (at least min_kinds kinds,
   by the smallest hash of each one's lines outside the template, or of all its lines if there is no other). Copies of one document are of one kind: its lines don't recur on their account;
   that is left to near-duplicate operators. Lines of a recurring template are dropped everywhere but in the smallest doc_id that holds it.

All counts are grouped sums over narrow rows that combine map-side, however many rows one node, leaf or template has; no group is collected. Bits in 64 cells are
a lower bound of the kinds; templates they leave open have their kinds counted one by one. All on DataFrame functions.

Edge cases: null text stays null, with no lines; blank lines and lines of fewer than min_tokens tokens, or of which more
than half are variable from the start, stay; order, ties and other columns are kept; repeated rows (same doc_id and text) are treated alike, each keeping the
lines that the first document keeps; lines are split at newlines only; hashes are of 64 bits. A token that is frequent enough to be constant parts a family of lines:
its rare variants count by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glyphweave.llm._expr import let
from glyphweave.session import cut

LEAD = 2
MIN_DOCS, MIN_KINDS, MIN_TOKENS = 8, 8, 4
#: Paths of more hashes belong to lines of 13 tokens and more; lines that hold up to so many frequent blocks are sought by two at a time.
LONG, PAIRED = 5, 12
WORDS = 1 << 18
#: Stands for a variable field.
FIELD = "\u0001"


def masked(line: Column) -> Column:
    """A lower-case line with FIELD for each variable token and single blanks between tokens. Lines without any skip the patterns."""
    odd = line.contains("  ")
    for space in "\t\x0b\x0c\r":
        odd = odd | line.contains(space)
    even = F.when(odd, F.regexp_replace(line, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(line)
    return let(even, lambda x: F.trim(F.when(x.rlike("[0-9@]"), F.regexp_replace(x, r"(?<![^\x20])[^\x200-9@]*+[0-9@][^\x20]*+", FIELD)).otherwise(x)))


def _blocks(line: Column) -> Column:
    """The hash of a masked line, and of each of its blocks of tokens by token count and place; none for a line that can't recur."""
    n = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1  # blanks and one
    fields = F.when(line.contains(FIELD), F.length(line) - F.length(F.replace(line, F.lit(FIELD), F.lit("")))).otherwise(0)
    part = lambda k: F.call_function("substring_index", line, F.lit(" "), k)

    def hashed(n: Column) -> Column:
        whole = F.xxhash64(line)

        def cut_in(k: int) -> Column:
            edge = [F.floor(n * j / k).cast("int") for j in range(k + 1)]
            inner = lambda j: F.call_function("substring_index", part(edge[j + 1]), F.lit(" "), edge[j] - edge[j + 1])
            return F.array(whole, *[F.xxhash64(n, F.lit(j), part(edge[1]) if j == 0 else part(edge[j] - n) if j == k - 1 else inner(j)) for j in range(k)])

        # two blocks more than a template may have variable places: the last 3 to 5 of two tokens, all others of three
        short = F.when(n % 3 == 0, 6).when(n % 3 == 1, 10).otherwise(8)
        tail = F.call_function("substring_index", line, F.lit(" "), -short)
        head = F.call_function("substring_index", line, F.lit(" "), n - short)
        blocks = F.concat(F.regexp_extract_all(head, F.lit(r"[^ ]++ [^ ]++ [^ ]++"), F.lit(0)), F.regexp_extract_all(tail, F.lit(r"[^ ]++ [^ ]++"), F.lit(0)))
        parted = F.concat(F.array(whole), F.transform(blocks, lambda x, j: F.xxhash64(n, j, x)))

        return F.when((n < MIN_TOKENS) | (2 * fields > n), F.array().cast("array<bigint>")).when(n < 7, cut_in(2)).when(n < 10, cut_in(3)).when(n < 13, cut_in(4)).otherwise(parted)

    return let(n, hashed)


def _lines(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, text_key, paths: per line its hash and its blocks' hashes, bits: of the three smallest line hashes)."""
    text = F.col("text")
    paths = F.transform(F.split(F.lower(text), "\n"), lambda x: let(masked(x), _blocks))
    rows = docs.where(text.isNotNull()).select("doc_id", F.xxhash64(text).alias("text_key"), paths.alias("paths"))
    own = F.slice(F.array_sort(F.array_distinct(F.transform(F.filter("paths", lambda p: F.size(p) > 0), lambda p: F.get(p, F.lit(0))))), 1, 3)
    bits = F.aggregate(own, F.lit(0).cast("long"), lambda a, h: a.bitwiseOR(_bit(h)))
    # texts without lines go when the table is read: a condition before it would have the blocks hashed a second time
    return cut(rows.withColumns({"bits": bits, "rid": F.monotonically_increasing_id()})).where(F.exists("paths", lambda p: F.size(p) > 0))


def _bit(kind: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(kind, F.lit(64)).cast("int"))


def _maybe(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose part has its bit among 2^24 bits of the keys: WORDS rows of 64 at most, whatever the number of keys, which lose no row."""
    word = F.pmod(F.shiftright("part", 6), F.lit(WORDS)).alias("word")
    bits = keys.groupBy(word).agg(F.bit_or(_bit(F.col("part"))).alias("mask"))
    return rows.withColumn("word", word).join(F.broadcast(bits), "word").where(F.col("mask").bitwiseAND(_bit(F.col("part"))) != 0).drop("word", "mask")


def _pairs(blocks: Column) -> Column:
    """A hash for each two of the blocks, which are in order."""
    return F.flatten(F.transform(blocks, lambda x, i: F.transform(F.slice(blocks, i + 2, F.size(blocks)), lambda y: F.xxhash64(x, y))))


def _candidates(docs: DataFrame, lines: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """Lines that are their own templates (rid, line, template), and lines (rid, line, tokens) that share a block, or two if they are long, with enough unlike documents.

    A document lends the bits of its three smallest line hashes: a group of copies has three at most.
    """
    held = lines.select("bits", F.explode(F.array_distinct(F.flatten("paths"))).alias("part")).groupBy("part").agg(F.count("*").alias("n"), F.bit_or("bits").alias("bits"))
    frequent = cut(held.where((F.col("n") >= min_docs) & (F.bit_count("bits") > 3)).select("part"))
    at = lines.select("rid", F.posexplode("paths").alias("line", "path")).select("rid", "line", (F.size("path") > LONG).alias("long"), F.posexplode("path").alias("j", "part"))
    # merged at every size; the bits keep most rows from being dealt out for it (a semi-join would be moved below them; a part is one row of frequent)
    met = _maybe(at, frequent).join(frequent.hint("merge"), "part").groupBy("rid", "line").agg(F.first("long").alias("long"), F.min(F.when(F.col("j") == 0, F.col("part"))).alias("template"), F.array_sort(F.collect_set(F.when(F.col("j") > 0, F.col("part")))).alias("blocks"))
    met = cut(met)
    own = met.where("template is not null").select("rid", "line", "template")
    rest = met.where("template is null").select("rid", "line", F.explode(F.when(F.col("long") & (F.size("blocks") <= PAIRED), _pairs(F.col("blocks"))).otherwise(F.col("blocks"))).alias("part"))
    again = rest.select("rid", "part").distinct().groupBy("part").count().where(F.col("count") >= min_docs).select("part")
    wanted = rest.join(again, "part", "left_semi").groupBy("rid").agg(F.collect_set("line").alias("wanted"))  # at most a document's own lines
    wanted = cut(wanted.join(lines.select("rid", "doc_id", "text_key"), "rid").select("rid", F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "wanted"))
    texts = docs.select("doc_id", "text").join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key")))
    each = texts.select("rid", "wanted", F.posexplode(F.split(F.lower("text"), "\n")).alias("line", "text")).where(F.array_contains("wanted", F.col("line")))
    return own, cut(each.select("rid", "line", F.split(masked(F.col("text")), " ").alias("tokens")).dropDuplicates(["rid", "line"]))


def _templated(found: DataFrame, min_docs: int) -> DataFrame:
    """(rid, line, template) of the candidates with few enough variable places."""
    rows = found.select("rid", "line", "tokens", F.size("tokens").alias("n"), F.lit(0).cast("long").alias("node"), F.lit(0).alias("known"))
    for k in range(LEAD):
        token = F.xxhash64(F.get("tokens", F.lit(k)))
        rows = rows.withColumn("token", token)
        child = rows.select("n", "node", "token", "rid").distinct().groupBy("n", "node", "token").count().where(F.col("count") >= min_docs).select("n", "node", "token", F.lit(1).alias("hit"))
        rows = rows.join(child, ["n", "node", "token"], "left")
        hit = F.coalesce("hit", F.lit(0))
        rows = rows.withColumns({"node": F.xxhash64("node", F.when(hit == 1, F.col("token"))), "known": F.col("known") + hit}).drop("token", "hit")
    rows = cut(rows.withColumn("leaf", F.xxhash64("n", "node")).drop("node"))
    rest = rows.select("rid", "line", "leaf", F.posexplode(F.slice("tokens", LEAD + 1, F.greatest(F.col("n") - LEAD, F.lit(0)))).alias("place", "token"))
    rest = rest.select("rid", "line", "leaf", F.xxhash64("place", "token").alias("token"))
    constant = cut(rest.select("leaf", "token", "rid").distinct().groupBy("leaf", "token").count().where(F.col("count") >= min_docs).select("leaf", "token"))
    kept = rest.join(constant, ["leaf", "token"]).groupBy("rid", "line").agg(F.count("*").alias("constants"), F.bit_xor("token").alias("mark"))
    full = rows.join(kept, ["rid", "line"], "left")
    variable = F.col("n") - F.col("known") - F.coalesce("constants", F.lit(0))
    few = 3 * variable < F.col("n")
    return cut(full.where(few).select("rid", "line", F.xxhash64("leaf", F.coalesce("mark", F.lit(0)), variable).alias("template")))


def _kinds(paths: Column) -> Column:
    """(template, kind) of each template of a document: the smallest hash of the lines outside the template, or of all if there are none."""

    def kinds(lines: Column) -> Column:
        outside = lambda t, i: F.when(~F.array_contains(F.get(lines, F.lit(i)), t), F.get(F.get(lines, F.lit(i)), F.lit(0)))
        # the lines are in order of their hash: the first or second nearly always lies outside
        rest = lambda t: F.get(F.get(F.filter(lines, lambda p: ~F.array_contains(p, t)), F.lit(0)), F.lit(0))
        kind = lambda t: F.coalesce(outside(t, 0), outside(t, 1), rest(t), F.get(F.get(lines, F.lit(0)), F.lit(0)))
        return F.transform(F.array_distinct(F.flatten(lines)), lambda t: F.struct(t.alias("template"), kind(t).alias("kind")))

    return let(F.array_sort(F.filter(paths, lambda p: F.size(p) > 0)), kinds)


def recurring(lines: DataFrame, templated: DataFrame, min_docs: int = MIN_DOCS, min_kinds: int = MIN_KINDS) -> DataFrame:
    """(template, n_docs, first_doc) of the templates that recur across unlike documents."""
    own = templated.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("line", "template"))).alias("own"))  # at most a document's own lines
    head = F.transform("paths", lambda p, i: F.when(F.size(p) > 0, F.array_compact(F.array(F.get(p, F.lit(0)), F.try_element_at("own", i)))).otherwise(F.array().cast("array<bigint>")))
    kinds = F.filter(_kinds(head), lambda k: F.array_contains(F.map_values("own"), k["template"]))
    each = lines.join(own, "rid").select("doc_id", F.explode(kinds).alias("k")).select("doc_id", "k.template", "k.kind")
    each = cut(each)
    found = each.groupBy("template").agg(F.count("*").alias("n_docs"), F.bit_or(_bit(F.col("kind"))).alias("bits"), F.min("doc_id").alias("first_doc"))
    found = cut(found.where(F.col("n_docs") >= min_docs))
    sure = F.bit_count("bits") >= min_kinds
    # kinds that share a cell: exact, over the few templates that are left
    open_ = each.join(found.where(~sure).select("template"), "template", "left_semi").select("template", "kind").distinct()
    enough = open_.groupBy("template").count().where(F.col("count") >= min_kinds).select("template")
    return found.where(sure).unionByName(found.where(~sure).join(enough, "template", "left_semi")).select("template", "n_docs", "first_doc")


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_kinds: int = MIN_KINDS) -> DataFrame:
    """(doc_id, text_key, dropped): the ordinals of the lines that go, one row for each text that loses any."""
    lines = _lines(docs)
    own, rest = _candidates(docs, lines, min_docs)
    templated = own.unionByName(_templated(rest, min_docs))
    templates = cut(recurring(lines, templated, min_docs, min_kinds))
    gone = templated.join(templates, "template").join(lines.select("rid", "doc_id", "text_key"), "rid").where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    return gone.groupBy("doc_id", "text_key").agg(F.collect_set("line").alias("dropped"))


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, min_kinds: int = MIN_KINDS) -> DataFrame:
    """docs with text rewritten and the column dropped (ordinals of the lines that went, in order; empty if none)."""
    gone = dropped_lines(docs.select("doc_id", "text"), min_docs, min_kinds).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.array_sort("dropped").alias("__gone"))
    # what goes grows with the input: a merge join at every size, so that the plan is the same on a small table and on a large one
    marked = docs.join(gone.hint("merge"), docs["doc_id"].eqNullSafe(gone["__id"]) & (F.xxhash64(docs["text"]) == gone["__key"]), "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    kept = [F.when(F.col("__gone").isNull(), F.col("text")).otherwise(left).alias("text") if c == "text" else docs[c] for c in docs.columns if c != "dropped"]
    return marked.select(*kept, F.coalesce("__gone", F.array().cast("array<int>")).alias("dropped"))


def drop_recurring(docs: DataFrame) -> DataFrame:
    """The documents without their recurring lines; those of which no word is left go. All columns as they are but text and n_chars."""
    out = line_dedup(docs).where((F.size("dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
