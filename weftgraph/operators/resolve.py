"""Entity resolution: leader clusters of similar names, canonical nodes, relations and enriched descriptions.

Clusters are sequential by definition (a name joins the first cluster whose *leader* is similar), which is a property of the graph of similar names: the leaders
are its first maximal independent set, found in rounds of joins.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import relation_type, similar_names, stem
from ..storage import discard, materialise

LABEL_ORDER = ("Topic", "Paper", "Author", "Concept", "Keyword")


def similar_pairs(names: DataFrame, jaccard: float = 0.6) -> DataFrame:
    """``a, b`` (a < b) of distinct similar names.

    Similar names share one of four kinds of keys, and only those meet: the whole stemmed name or one of its rarest stems (as many as overlaps of
    ``jaccard`` need), an acronym and the initials of a phrase with or without its short words, the first word of the shorter name and any
    word of the longer.
    """
    low = F.lower(F.trim("name"))
    words = F.filter(F.split(low, "\\s+"), lambda w: w != "")
    stems = F.filter(F.transform(F.split(F.replace(low, F.lit("-"), F.lit(" ")), "\\s+"), stem), lambda w: w != "")
    plain = F.filter(F.split(F.regexp_replace(low, "[^a-z\\s]", " "), "\\s+"), lambda w: w != "")
    main = F.filter(plain, lambda w: ~w.isin("of", "and", "in", "from", "for", "with", "the"))
    initials = lambda ws: F.array_join(F.transform(ws, lambda w: F.substring(w, 1, 1)), "")
    src = names.where("name is not null").select("name").distinct()
    src = materialise(
        src.select(
            "name", words.alias("words"), stems.alias("stems"), F.array_distinct(F.array(initials(plain), initials(main))).alias("initials"),
            F.regexp_replace(low, "[^a-z]", "").alias("letters"), F.size(plain).alias("n_plain"),
        ),
        "names",
    )
    # stems, rarest first
    each = src.select("name", F.size(F.array_distinct("stems")).alias("n"), F.explode(F.array_distinct("stems")).alias("key"))
    often = each.groupBy("key").agg(F.count("*").alias("c"))
    place = F.row_number().over(Window.partitionBy("name").orderBy("c", "key"))
    rare = each.join(often, "key").withColumn("p", place).where(F.col("p") <= F.col("n") - F.ceil(F.col("n") * jaccard) + 1).select("name", F.concat(F.lit("s:"), "key").alias("key"))
    whole = src.select("name", F.concat(F.lit("="), F.array_join("stems", " ")).alias("key"))
    left = rare.unionByName(whole)
    both = left.unionByName(src.where(F.length("letters").between(2, 6)).select("name", F.concat(F.lit("i:"), "letters").alias("key")))
    both = both.unionByName(src.where((F.size("words") > 0) & (F.length("name") > 4)).select("name", F.concat(F.lit("f:"), F.get("words", F.lit(0))).alias("key")))
    other = left.unionByName(src.where("n_plain >= 2").select("name", F.explode("initials").alias("k")).select("name", F.concat(F.lit("i:"), "k").alias("key")))
    other = other.unionByName(src.where(F.length("name") > 4).select("name", F.explode(F.array_distinct("words")).alias("k")).select("name", F.concat(F.lit("f:"), "k").alias("key")))
    met = both.select(F.col("name").alias("x"), "key").join(other.select(F.col("name").alias("y"), "key"), "key").where("x != y")
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return pairs.where(similar_names(F.col("a"), F.col("b"), jaccard))


def earliest_leaders(places: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, leader``: the place of the leader that each place joins, its own if it leads.

    ``places``: ``keys, place``; ``edges``: ``keys, before, place`` for each pair of similar places, the earlier one first. A place leads if no earlier leader is
    similar to it, so the leaders are the first maximal independent set in the order of places. It is found in rounds: what waits for nothing earlier leads, what is similar to
    a new leader falls, and the links of both go. A round reads the links that are left, never a whole scope at once; there are as many rounds as the longest chain of
    places each of which has to wait for the one before.
    """
    edges = materialise(edges, "similar")
    link, fallen, live, used = [*keys, "place"], None, edges, []
    while not live.isEmpty():
        waits = live.select(*link).distinct()
        leads = live.select(*keys, F.col("before").alias("place")).distinct().join(waits, link, "left_anti")
        down = materialise(live.join(leads.select(*keys, F.col("place").alias("before")), [*keys, "before"], "left_semi").select(*link).distinct(), "fallen")
        rest = live.join(down, link, "left_anti").join(down.select(*keys, F.col("place").alias("before")), [*keys, "before"], "left_anti")
        rest = materialise(rest, "waiting")
        fallen = down if fallen is None else fallen.unionByName(down)
        used += [rest]
        live = rest
    for df in used:
        discard(df)
    if fallen is None:
        return places.select(*link, F.col("place").alias("leader"))
    led = edges.join(fallen.select(*keys, F.col("place").alias("before")), [*keys, "before"], "left_anti").groupBy(*link).agg(F.min("before").alias("leader"))
    return places.join(led, link, "left").select(*link, F.coalesce("leader", "place").alias("leader"))


#: Places of one scope that are numbered together.
_BLOCK = 1 << 16


def leader_clusters(mentions: DataFrame, scope: str = "doc_id") -> DataFrame:
    """``scope, ord, label, name, description, is_existing, cluster``: a name joins the first cluster whose leader is similar, clusters are numbered in order of their leaders.

    Names come in order of ``is_existing`` (those first), ``ord`` and, where both are equal, ``name``. Similar names are found once over all scopes (``similar_pairs``) and
    meet within their scope; ``earliest_leaders`` does the rest, so that a scope may be of any size. Null and empty names take no part; a null scope is a scope.
    """
    names = [scope, "ord", "label", "name", "description", "is_existing"]
    src = mentions.select(*names).where("name is not null and name != ''")
    place = F.struct((~F.col("is_existing")).alias("fresh"), "ord", "name")
    key = F.struct(F.col(scope).alias("scope")).alias("key")  # a struct with a null field equals itself in joins
    places = materialise(src.select(key, "name", place.alias("place")).groupBy("key", "name").agg(F.min("place").alias("place")), "places")
    pairs = similar_pairs(places.select("name"))
    one = places.join(pairs.select(F.col("a").alias("name"), F.col("b").alias("other")), "name").select("key", F.col("other").alias("name"), F.col("place").alias("x"))
    edges = one.join(places, ["key", "name"]).select("key", F.least("x", "place").alias("before"), F.greatest("x", "place").alias("place"))
    led = materialise(earliest_leaders(places.select("key", "place"), edges, ["key"]), "led")

    # numbers without a sort of a whole scope: blocks of places are numbered by themselves, after the leaders of the blocks before
    block = F.struct("leader.fresh", F.floor(F.col("leader.ord") / _BLOCK).alias("part"))
    leaders = led.where("leader = place").select("key", "leader", block.alias("block"))
    counts = leaders.groupBy("key", "block").agg(F.count("*").alias("own"))
    before = F.coalesce(F.sum("own").over(Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = leaders.join(counts.select("key", "block", before.alias("base")), ["key", "block"])
    numbered = numbered.withColumn("cluster", (F.col("base") + F.row_number().over(Window.partitionBy("key", "block").orderBy("leader")) - 1).cast("int"))
    of = led.join(numbered.select("key", "leader", "cluster"), ["key", "leader"]).select("key", F.col("place.name").alias("name"), "cluster")
    return src.withColumn("key", key).join(of, ["key", "name"]).select(*names, "cluster")


def is_title(name: Column) -> Column:
    """Each run of letters begins with a capital and goes on without, and there is one at least."""
    return name.rlike("\\p{L}") & ~name.rlike("\\p{L}\\p{Lu}|(?:^|\\P{L})\\p{Ll}")


def canonical_nodes(clustered: DataFrame, scope: str = "doc_id") -> DataFrame:
    """``scope, cluster, label, name, description, members``: the representative by an ordered fold, descriptions joined up to 300 characters."""
    member = F.struct((~F.col("is_existing")).alias("fresh"), "ord", "label", "name", F.coalesce(F.trim("description"), F.lit("")).alias("description"), "is_existing")
    got = clustered.groupBy(scope, "cluster").agg(F.array_sort(F.collect_list(member)).alias("m"))
    priority = lambda x: F.coalesce(F.when(x["label"].isin(*LABEL_ORDER), F.array_position(F.array(*map(F.lit, LABEL_ORDER)), x["label"])), F.lit(99))
    titled = lambda x: is_title(x["name"])

    def better(rep, x):
        swap = (
            F.when(x["is_existing"] & ~rep["is_existing"], True)
            .when(rep["is_existing"] & ~x["is_existing"], False)
            .otherwise((priority(x) < priority(rep)) | ((priority(x) == priority(rep)) & ((F.length(x["name"]) > F.length(rep["name"])) | (titled(x) & ~titled(rep)))))
        )
        return F.when(swap, x).otherwise(rep)

    rep = F.aggregate(F.slice("m", F.lit(2), F.size("m")), F.get("m", F.lit(0)), better)
    told = F.array_join(F.array_distinct(F.filter(F.transform("m", lambda x: x["description"]), lambda d: d != "")), " ")
    told = F.when(F.length(told) > 300, F.concat(F.substring(told, 1, 297), F.lit("..."))).otherwise(told)
    return got.withColumn("rep", rep).select(scope, "cluster", F.col("rep.label").alias("label"), F.trim("rep.name").alias("name"), told.alias("description"), F.size("m").alias("members"))


def name_mapping(clustered: DataFrame, canonical: DataFrame, scope: str = "doc_id") -> DataFrame:
    """``scope, key, canonical``: lower-cased member name to canonical name; the last cluster wins."""
    rows = clustered.select(scope, "cluster", F.lower(F.trim("name")).alias("key")).join(canonical.select(scope, "cluster", F.col("name").alias("canonical")), [scope, "cluster"])
    return rows.groupBy(scope, "key").agg(F.max_by("canonical", "cluster").alias("canonical"))


def name_frequency(mentions: DataFrame, mapping: DataFrame, scope: str = "doc_id") -> DataFrame:
    """``scope, name, freq``: how often each canonical name is mentioned, under whatever name."""
    key = mentions.select(scope, F.lower(F.trim("name")).alias("key"), "name")
    named = key.join(mapping, [scope, "key"], "left").select(scope, F.coalesce("canonical", "name").alias("name"))
    return named.groupBy(scope, "name").agg(F.count("*").alias("freq"))


def canonical_relations(rels: DataFrame, mapping: DataFrame, scope: str = "doc_id") -> DataFrame:
    """``scope, from_name, to_name, type``: typed, mapped, without self-loops, each once."""
    src = rels.where("from_name is not null and from_name != '' and to_name is not null and to_name != ''")
    key = lambda c: F.lower(F.trim(c))
    for side in ("from_name", "to_name"):
        m = mapping.select(scope, F.col("key").alias("_k"), F.col("canonical").alias("_c"))
        src = src.withColumn("_k", key(side)).join(m, [scope, "_k"], "left").withColumn(side, F.coalesce("_c", side)).drop("_k", "_c")
    return src.select(scope, "from_name", "to_name", relation_type(F.coalesce("type", F.lit("RELATED_TO"))).alias("type")).where(key("from_name") != key("to_name")).distinct()


_DEFINES = (" is ", " are ", " refers to ", " is defined as ", " represents ", " denotes ", " refers ")


@functools.lru_cache(1 << 14)
def _whole(name: str) -> re.Pattern:
    return re.compile(rf"\b{re.escape(name)}\b", re.IGNORECASE)


def places_of(name: str, text: str, low: str) -> list[tuple[int, int]]:
    """Where a name stands as whole words of a text, regardless of case, from left to right. ``low``: the text in lower case.

    No pattern is compiled where the name is ASCII and the text has none of the letters that fold to ASCII other than by lower case, or change their length by it.
    """
    if not (name and name.isascii() and (text.isascii() or not any(c in text for c in "\u0130\u0131\u017f"))):
        return [m.span() for m in _whole(name).finditer(text)]
    key, at, spots = name.lower(), 0, []
    word = lambda i: 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")
    while (at := low.find(key, at)) >= 0:
        end = at + len(key)
        if word(at - 1) != word(at) and word(end - 1) != word(end):
            spots.append((at, end))
            at = end
        else:
            at += 1
    return spots


_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
_SAYS = re.compile(f" (?={'|'.join(re.escape(p[1:]) for p in _DEFINES)})")


def defining_places(text: str, low: str) -> list[int] | None:
    """Where words that define begin in a text, from left to right; none are told (null) where its lower case has other places."""
    return [m.start() for m in _SAYS.finditer(low)] if len(low) == len(text) else None


def describe(name: str, description: str | None, text: str, low: str | None = None, said: list[int] | None = None) -> str:
    """A poor description replaced by a defining or at least long sentence around the name. ``low``: the text in lower case, ``said``: its ``defining_places``, where they are at hand."""
    desc, name = (description or "").strip(), (name or "").strip()
    if desc and len(desc.split()) >= 12 and not any(p in desc.lower() for p in ("placeholder", "no description", "extracted yet")):
        return description
    low = text.lower() if low is None else low
    spots = places_of(name, text, low)
    if not spots and (at := low.find(name.lower())) >= 0:
        spots = [(at, at + len(name))]

    key = name.lower()

    def sentence(a, b, before, after, good):
        window = text[max(0, a - before) : b + after]
        return next((s for s in map(str.strip, _SENTENCE_END.split(window)) if key in s.lower() and good(s)), "")

    def may(a, b):
        """Whether words that define begin near a place: only then can a sentence there have them."""
        return said is None or ((k := bisect.bisect_left(said, a - 150)) < len(said) and said[k] < b + 250)

    found = next((s for a, b in spots if may(a, b) and (s := sentence(a, b, 150, 250, lambda s: len(s.split()) >= 10 and any(p in s.lower() for p in _DEFINES)))), "")
    if not found and spots:
        found = sentence(*spots[0], 100, 200, lambda s: len(s.split()) >= 8)
    if found:
        found = re.sub(r"\s+", " ", found).strip()
        found = found[:247] + "..." if len(found) > 250 else found
        return found[:1].upper() + found[1:]
    return description if desc else f"Key concept of {name} extracted from the document."


def enrich(canonical: DataFrame, documents: DataFrame) -> DataFrame:
    """Canonical nodes with ``description`` enriched from their document's ``text``; one row of a document carries the text to all its nodes."""
    grouped = canonical.groupBy("doc_id").agg(F.collect_list(F.struct("cluster", "label", "name", "description", "members")).alias("nodes"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            docs, nodes, texts = (batch.column(i).to_pylist() for i in range(3))
            for doc, own, text in zip(docs, nodes, texts, strict=True):
                plain = re.sub(r"\s+", " ", text or "")
                low = plain.lower()
                said = defining_places(plain, low)
                rows = [x | {"description": describe(x["name"], x["description"], plain, low, said)} for x in own]
                out = pa.RecordBatch.from_pylist(rows, schema=pa.schema([("cluster", pa.int32()), ("label", pa.string()), ("name", pa.string()), ("description", pa.string()), ("members", pa.int32())]))
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(rows), batch.schema.field(0).type), *out.columns], names=["doc_id", *out.schema.names])

    kind = canonical.schema["doc_id"].dataType.simpleString()
    joined = grouped.join(documents.select("doc_id", "text"), "doc_id").select("doc_id", "nodes", "text")
    return joined.mapInArrow(run, f"doc_id {kind}, cluster int, label string, name string, description string, members int")


def quality_gate(scored: DataFrame, scope: str = "doc_id", threshold: float = 0.7, fail_share: float = 0.8) -> DataFrame:
    """``scope, low_share, passed``: a scope fails when more than ``fail_share`` of its mentions are of low quality."""
    share = F.avg((F.col("quality") <= threshold).cast("int"))
    return scored.groupBy(scope).agg(share.alias("low_share")).withColumn("passed", F.col("low_share") <= fail_share)


def first_wins(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
