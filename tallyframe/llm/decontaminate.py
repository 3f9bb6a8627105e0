"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. The windows of an item are its
spans of ``SPAN`` words; an item of fewer words is one window of its own size. A document word inside any
occurrence of a window is hit.

Winnowing: of the hashes of ``GRAM`` words, each span of ``SPAN`` words keeps its smallest. That depends on
the words of the span alone, so a span that stands in a document and in an item keeps the same hash in both:
every shared span of ``SPAN`` words or more is found. Neighbouring spans mostly keep the same hash, and one
fingerprint stands for such a run. Fingerprints of the documents are joined to the hashes that items keep;
each hit is then extended to the spans that its run stands for, whose words are compared (by a 128-bit
digest) with the windows of the items. Items shorter than ``SPAN`` keep the hash of all their words, and
documents are asked for those of exactly the sizes that occur, at most ``SPAN`` - 1 of them.

Only fingerprints are dealt by hash, and both sides of both joins to the benchmark are such that a document's
row meets one row: windows are distinct, and the items that hold a window are known by one set, so a
passage in many documents and many items never gives their product. The items of a document are put together
once for each different collection of such sets. The texts are shuffled once, to extend the hits.

Defined results: a null or wordless text has no words and no hits; a null or wordless item has no windows; a
null ``item_id`` gives hits but is neither counted nor listed; repeated items count once; a repeated document
gives its row again, a null ``doc_id`` stays null; without items nothing is hit; an empty table of documents
gives an empty result. Other columns of the tables are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import let
from .runtime import whole_text, written

NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a window, and of the grams whose smallest hash it keeps.
SPAN, GRAM = 10, 5
#: A fingerprint: the kept hash, the first span that keeps it, and how many in a row do.
ENTRIES = "array<struct<mark:bigint,start:int,spans:int>>"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), NO_WORD), "")


def places(count: Column, use) -> Column:
    """``use(i)`` for i from 0 to count - 1; ``count`` must be 1 or more."""
    return F.transform(F.sequence(F.lit(0), count - 1), use)


def kept_marks(hashes: Column) -> Column:
    """For each span of ``SPAN`` words the smallest hash of its grams, from SPAN words or more."""
    grams = places(F.size(hashes) - (GRAM - 1), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(GRAM)]))
    inside = SPAN - GRAM + 1
    return let(grams, lambda g: places(F.size(g) - (inside - 1), lambda i: F.least(*[F.get(g, i + j) for j in range(inside)])))


def short_mark(hashes: Column, start: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(hashes, start + j) for j in range(size)])


def fingerprints(hashes: Column, sizes: list[int]) -> Column:
    """The fingerprints of a text from the hashes of its words; ``sizes`` are those of short items."""

    def runs(marks: Column) -> Column:
        first = lambda i: (i == 0) | (F.get(marks, i) != F.get(marks, i - 1))
        starts = F.filter(F.sequence(F.lit(0), F.size(marks) - 1), first)
        end = lambda s, j: F.coalesce(F.get(s, j + 1), F.size(marks))
        return let(starts, lambda s: F.transform(s, lambda i, j: F.struct(F.get(marks, i).alias("mark"), i.alias("start"), (end(s, j) - i).alias("spans"))))

    def whole(size: int) -> Column:
        return places(F.size(hashes) - (size - 1), lambda i: F.struct(short_mark(hashes, i, size).alias("mark"), i.alias("start"), F.lit(1).alias("spans")))

    none = F.array().cast(ENTRIES)
    parts = [F.when(F.size(hashes) >= SPAN, let(kept_marks(hashes), runs).cast(ENTRIES)).otherwise(none)]
    for size in sizes:
        parts.append(F.when(F.size(hashes) >= size, whole(size).cast(ENTRIES)).otherwise(none))
    return F.concat(*parts)


def window_digest(words: Column, start: Column, size: Column) -> Column:
    return F.unhex(F.md5(F.array_join(F.slice(words, start + 1, size), " ")))


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The windows of the items (item_id, digest, size, mark), each once for an item."""
    read = items.select(F.col(f"`{item_id}`").alias("item_id"), words_of(whole_text(f"`{text}`")).alias("words")).where(F.size("words") > 0)
    hashed = read.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    w, h = F.col("words"), F.col("hashes")
    window = lambda start, size, mark: F.struct(window_digest(w, start, size).alias("digest"), size.alias("size"), mark.alias("mark"))
    long = let(kept_marks(h), lambda m: places(F.size(m), lambda i: window(i, F.lit(SPAN), F.get(m, i))))
    short = F.array(window(F.lit(0), F.size(w), F.element_at(F.array(*[short_mark(h, F.lit(0), n) for n in range(1, SPAN)]), F.size(w))))
    windows = hashed.select("item_id", F.explode(F.when(F.size(w) >= SPAN, long).otherwise(short)).alias("window"))
    return windows.select("item_id", "window.*").distinct()


def item_sets(windows: DataFrame) -> DataFrame:
    """Each window once (digest, size, mark, items), where ``items`` names the set of items that hold it.

    A set is known by its size and two 64-bit sums without carry of its ids' hashes, so its members are
    never gathered.
    """
    known = F.struct(
        F.count("item_id").alias("n"),
        F.bit_xor(F.when(F.col("item_id").isNotNull(), F.xxhash64("item_id"))).alias("a"),
        F.bit_xor(F.when(F.col("item_id").isNotNull(), F.xxhash64(F.lit("second"), "item_id"))).alias("b"),
    )
    return windows.groupBy("digest", "size", "mark").agg(known.alias("items"))


def covered_words(spans: Column) -> Column:
    """How many words spans (start, size) cover together."""
    zero = F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).alias("end"))

    def add(so_far: Column, x: Column) -> Column:
        end = x["start"] + x["size"]
        new = F.greatest(end - F.greatest(x["start"], so_far["end"]), F.lit(0))
        return F.struct((so_far["words"] + new).alias("words"), F.greatest(end, so_far["end"]).alias("end"))

    return F.aggregate(F.sort_array(spans), zero, add, lambda end: end["words"])


def same_row(left: str, right: str) -> Column:
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (F.col(f"{left}.text_id") == F.col(f"{right}.text_id"))


def contaminated_spans(docs: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All documents (doc_id, text_id, n_words), and those with hits (doc_id, text_id, n_hit, spans, sets).

    ``docs`` has doc_id and text; ``windows`` is the result of ``item_sets``. A row is known by its id and a
    digest of its text, which stay the same when the table is read again.
    """
    rows = docs.select("doc_id", F.unhex(F.md5(whole_text())).alias("text_id"), whole_text().alias("text"))
    marks = written(windows.select("mark", "size").distinct(), "marks")
    sizes = sorted(r["size"] for r in marks.select("size").where(F.col("size") < SPAN).distinct().collect())
    words = rows.select("doc_id", "text_id", words_of(F.col("text")).alias("words"))
    hashed = words.select("doc_id", "text_id", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    prints = F.when(F.size("hashes") > 0, fingerprints(F.col("hashes"), sizes)).otherwise(F.array().cast(ENTRIES))
    measured = written(hashed.select("doc_id", "text_id", F.size("hashes").cast("long").alias("n_words"), prints.alias("entries")), "fingerprints")

    entries = measured.select("doc_id", "text_id", F.explode("entries").alias("entry")).select("doc_id", "text_id", "entry.*")
    hits = entries.join(marks, "mark").groupBy("doc_id", "text_id").agg(F.collect_set(F.struct("size", "start", "spans")).alias("hits"))
    hits = written(hits, "hits")

    def extended(words: Column) -> Column:
        """The spans that the hits stand for, with the digests of their words."""
        # One number for place and size: structs would be told apart pair by pair.
        each = F.transform("hits", lambda x: F.transform(F.sequence(x["start"], x["start"] + x["spans"] - 1), lambda i: i.cast("long") * 16 + x["size"]))
        start, size = lambda x: F.floor(x / 16).cast("int"), lambda x: (x % 16).cast("int")
        digest = lambda x: F.struct(start(x).alias("start"), size(x).alias("size"), window_digest(words, start(x), size(x)).alias("digest"))
        return F.transform(F.array_distinct(F.flatten(each)), digest)

    # The hits grow with the input: they are dealt with the texts at every size, never broadcast.
    again = rows.alias("r").join(hits.hint("merge").alias("h"), same_row("r", "h")).select("r.doc_id", "r.text_id", "text", "hits")
    spans = again.select("doc_id", "text_id", F.explode(let(words_of(F.col("text")), extended)).alias("span")).select("doc_id", "text_id", "span.*")
    found = spans.join(windows.select("digest", "items"), "digest").groupBy("doc_id", "text_id")
    found = found.agg(F.collect_set(F.struct("start", "size")).alias("spans"), F.sort_array(F.collect_set("items")).alias("sets"))
    n_hit = covered_words(F.col("spans")).alias("n_hit")
    return measured.select("doc_id", "text_id", "n_words"), found.select("doc_id", "text_id", n_hit, F.sort_array("spans").alias("spans"), "sets")


def sets_id(sets: Column) -> Column:
    return F.unhex(F.md5(F.to_json(sets)))


def items_of_sets(found: DataFrame, windows: DataFrame, members: DataFrame) -> DataFrame:
    """For each different ``sets`` of ``found`` (sets_id) the items they hold: n_items, items_sha256."""
    # Any window of a set stands for it.
    named = windows.groupBy("items").agg(F.min("digest").alias("digest"))
    in_set = members.where("item_id IS NOT NULL").join(named, "digest").select("items", F.col("item_id").cast("string").alias("item"))
    each = found.select("sets_id", "sets").dropDuplicates(["sets_id"]).select("sets_id", F.explode("sets").alias("items"))
    items = each.join(in_set, "items").select("sets_id", "item").distinct().groupBy("sets_id")
    listed = F.array_join(F.sort_array(F.collect_list("item")), ",")
    return items.agg(F.count("*").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"))


def decontamination_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """For each document how many words are hit, and by which items."""
    members = written(item_windows(items), "item-windows")
    windows = written(item_sets(members), "windows")
    measured, found = contaminated_spans(docs.select("doc_id", "text"), windows)
    found = written(found.select("doc_id", "text_id", "n_hit", "sets", sets_id(F.col("sets")).alias("sets_id")), "found")
    named = items_of_sets(found, windows, members)
    hit = found.drop("sets").join(named, "sets_id", "left").drop("sets_id")
    joined = measured.alias("m").join(hit.alias("f"), same_row("m", "f"), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(
        F.col("m.doc_id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no word is hit."""
    windows = written(item_sets(written(item_windows(items), "item-windows")), "windows")
    # In a struct, columns of the caller can't clash with those made here.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    _, found = contaminated_spans(rows.select("doc_id", "text"), windows)
    known = rows.select("_row", "doc_id", F.unhex(F.md5(whole_text())).alias("text_id"))
    return known.alias("r").join(found.alias("f"), same_row("r", "f"), "left_anti").select("_row.*")
