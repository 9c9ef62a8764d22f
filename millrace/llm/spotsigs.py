"""Document fingerprints by SpotSigs: chains of content words that follow common words. DataFrame functions only."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut, let

# Common words of English, German, French and Spanish, the anchors of the chains.
COMMON = """
a about all also an and any are as at be because been but by can could did do does for from had has have he her his
how i if in into is it its just like may more most no not of on one only or other our out over said she so some such
than that the their them then there these they this to up was we were what when where which who will with would you your
aber als am auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer eines er es für hat ich
ihr im ist kann man mit nach nicht noch nur oder sein sich sie sind über um und uns von vor war wenn werden wie wir wird
zu zum zur
au aux avec ce ces cette comme dans de du elle en est et être il ils je la le les leur lui mais ne nous on ont ou par
pas plus pour qu que qui sa se ses son sont sur un une vous à
al con como del donde el ella entre era ese esta este está fue ha hay la las lo los más me mi muy ni nos o para pero
por que se si sin sobre su sus también todo un una uno y ya
""".split()

LENGTH_RATIO = 0.05


#: A stretch of more characters than this between common words is signed at each of its words.
LONG_STRETCH = 120


def pieces(text: Column) -> Column:
    """A text cut before each common word, as strings: the common word, then the content words after it, a space after each.

    Words are runs of letters and digits, lower-cased. The first piece is headed by ``^``; pieces without content words
    are left out.
    """
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")
    marked = F.array_join(F.transform(words, lambda w: F.when(w.isin(COMMON), F.concat(F.lit("#"), w)).otherwise(w)), " ")
    return F.filter(F.split(F.concat(F.lit("#^ "), marked, F.lit(" ")), "#"), lambda p: F.instr(F.rtrim(p), " ") > 0)


def anchored(cut_: Column, chain: int) -> Column:
    """The chain of each piece: its common word and ``chain`` content words, over later common words, fewer at the end."""

    def words_after(i: Column) -> list[Column]:
        return [F.coalesce(F.substring_index(F.substring_index(F.get(cut_, i + k), " ", 2), " ", -1), F.lit("")) for k in range(1, chain)]

    # Each later piece adds one word, which counts only where those before have too few.
    return F.transform(cut_, lambda p, i: F.hash(F.substring_index(F.concat_ws(" ", F.rtrim(p), *words_after(i)), " ", chain + 1)))


def unanchored(words: Column, chain: int) -> Column:
    """The chains of ``chain`` + 1 words from each of ``words`` on, fewer at the end."""
    return F.transform(words, lambda w, i: F.hash(F.lit("*"), F.array_join(F.slice(words, i + 1, F.lit(chain + 1)), " ")))


def signatures(text: Column, chain: int = 2) -> Column:
    """The signatures (distinct 32-bit numbers) of a text, null counting as empty; a repeated chain gets one for each time.

    Each common word that a content word follows anchors a signature: the common word and the next ``chain`` content
    words, over common words in between, fewer at the end. So does the start of the text. Only where there is no common
    word to anchor one, in stretches of over ``LONG_STRETCH`` characters (tables, other languages), each word begins a
    signature of plain words. A text of common words alone takes all words as content; one without words has one
    signature of the whole text; an empty text has none.
    """
    text = F.coalesce(text, F.lit(""))
    plain = lambda p: let(F.split(F.rtrim(p), " "), lambda w: unanchored(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(1))), chain))

    def of(cut_: Column) -> Column:
        bare = F.filter(cut_, lambda p: F.length(p) > LONG_STRETCH)
        both = F.when(F.size(bare) > 0, F.concat(anchored(cut_, chain), F.flatten(F.transform(bare, plain)))).otherwise(anchored(cut_, chain))
        words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")
        return F.when(F.size(cut_) > 0, both).otherwise(let(words, lambda w: unanchored(w, chain)))

    def numbered(again: Column) -> Column:
        """Of each run of equal chains in order, which had one before, all with their number."""
        ends = let(F.filter(F.transform(again, lambda x, i: F.when((i == 0) | (F.get(again, i - 1) != x), i)), lambda i: i.isNotNull()), lambda starts: F.transform(starts, lambda b, j: F.struct(b.alias("b"), F.coalesce(F.get(starts, j + 1), F.size(again)).alias("e"))))
        return F.flatten(F.transform(ends, lambda r: F.transform(F.sequence(F.lit(1), r["e"] - r["b"]), lambda k: F.hash(F.get(again, r["b"]), k))))

    def told_apart(s: Column) -> Column:
        again = F.filter(s, lambda x, i: (i > 0) & (F.get(s, i - 1) == x))
        return let(again, lambda a: F.when(F.size(a) == 0, s).otherwise(F.sort_array(F.array_distinct(F.concat(s, numbered(a))))))

    whole = let(let(pieces(text), of), lambda s: F.when((F.size(s) > 0) | (text == ""), s).otherwise(F.array(F.hash(text))))
    return let(F.sort_array(whole), told_apart)


def anchored_share(text: Column, chain: int = 2) -> Column:
    """The share of a text's chains, repeated ones counting each time, that a common word anchors; null without chains."""
    text = F.coalesce(text, F.lit(""))

    def share(cut_: Column) -> Column:
        bare = F.aggregate(F.filter(cut_, lambda p: F.length(p) > LONG_STRETCH), F.lit(0), lambda a, p: a + F.size(F.split(F.rtrim(p), " ")) - 1)
        starts = F.size(F.filter(cut_, lambda p: F.substring(p, 1, 1) == "^"))
        return let(bare, lambda n: (F.size(cut_) - starts) / F.nullif(F.size(cut_) + n, F.lit(0)))

    return let(pieces(text), share)


def fingerprint(sigs: Column) -> Column:
    """The signatures as text: eight hexadecimal digits each, in order."""
    return F.array_join(F.transform(sigs, lambda s: F.lpad(F.lower(F.hex(s.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def length_partition(sigs: Column, least: float = LENGTH_RATIO) -> Column:
    """Sets at a likeness of ``least`` or more lie in the same partition of lengths or in neighbouring ones."""
    return F.floor(F.log(F.greatest(F.size(sigs), F.lit(1)).cast("double")) / F.lit(log(1 / least))).cast("int")


def likeness(left: Column, right: Column, least: float = LENGTH_RATIO) -> Column:
    """The Jaccard likeness of two signature sets (counting repeated chains), pruned: 0 where their lengths alone keep it below ``least``.

    Partitions of lengths more than one apart, then the ratio of lengths, rule pairs out before the sets are met.
    Two empty sets are alike (1), an empty and another are not (0).
    """
    a, b = F.size(left), F.size(right)
    far = F.abs(length_partition(left, least) - length_partition(right, least)) > 1
    both = F.size(F.array_intersect(left, right))
    return F.when((a == 0) & (b == 0), 1.0).when((a == 0) | (b == 0) | far | (F.least(a, b) < F.lit(least) * F.greatest(a, b)), 0.0).otherwise(let(both, lambda n: n / (a + b - n)))


def jaccard(left: Column, right: Column) -> Column:
    """The exact Jaccard likeness of a single pair, whatever the sets' lengths; two empty sets are alike (1)."""
    a, b = F.size(left), F.size(right)
    return F.when((a == 0) & (b == 0), 1.0).otherwise(let(F.size(F.array_intersect(left, right)), lambda n: n / (a + b - n)))


def next_ids(docs: DataFrame, key: str) -> DataFrame:
    """Each distinct ``key`` with ``after``, the next smaller one; after the smallest comes the largest.

    Ids are range-partitioned and ordered within the partitions, each on its own; only the partitions' first ids, as
    many as there are partitions, pass through the driver to close the gaps between them.
    """
    order = F.col(key).desc()
    ids = cut(docs.select(key).distinct().repartitionByRange(order).select(key, F.spark_partition_id().alias("part")))
    heads = sorted((-r["head"], r["part"]) for r in ids.groupBy("part").agg(F.max(key).alias("head")).collect())
    follow = [(part, -heads[(i + 1) % len(heads)][0]) for i, (_, part) in enumerate(heads)]
    closing = docs.sparkSession.createDataFrame(follow, "part int, head long")
    inside = F.lead(key).over(Window.partitionBy("part").orderBy(order))
    return ids.select(key, "part", inside.alias("inside")).join(F.broadcast(closing), "part").select(key, F.coalesce("inside", "head").alias("after"))


def fingerprint_edits(docs: DataFrame, chain: int = 2) -> DataFrame:
    """Fingerprints of whole texts and of edited ones, a row per row of ``docs`` (``doc_id``, ``text``).

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all) of the next
    document, in descending order of id, the first after the last. Returns ``doc_id``, ``n_chars``, ``edited_sha256``,
    ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and ``near_next``, the exact likeness of the fingerprint to the
    edited text's and the next document's, and ``n_signatures``. A null text is an empty one; a null id counts as
    smaller than all others and stays null; of rows that share an id, the least text is the next document's. A single id
    is its own next. No rows give no rows.
    """
    smallest = -(2**63)
    key, text = F.coalesce("doc_id", F.lit(smallest)), F.coalesce("text", F.lit(""))
    base = docs.select(key.alias("k"), text.alias("text"))
    after = next_ids(base, "k")
    third = F.floor(F.char_length("text") / 3).cast("int")
    wants = base.groupBy("k").agg(F.max(third).alias("want"), F.count("*").alias("n"))
    needs = wants.join(after, "k").select(F.col("after").alias("nk"), F.col("k").alias("pk"), "want")
    # Signed before they are dealt, so that both sides of the join read the same exchange.
    signed = base.withColumn("sigs", signatures(F.col("text"), chain)).repartition("k")
    nexts = signed
    if not wants.where("n > 1").isEmpty():
        nexts = signed.groupBy("k").agg(F.min(F.struct("text", "sigs")).alias("x")).select("k", "x.*")
    heads = nexts.join(needs, nexts["k"] == needs["nk"]).select("pk", F.substring(F.col("text"), F.lit(1), F.col("want")).alias("head"), F.col("sigs").alias("next_sigs"))
    met = signed.join(heads, signed["k"] == heads["pk"])
    n = F.char_length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("head"), F.lit(1), third))
    rows = met.select("k", n.cast("long").alias("n_chars"), "sigs", "next_sigs", edited.alias("edited"))
    rows = rows.select("k", "n_chars", "sigs", "next_sigs", F.sha2("edited", 256).alias("edited_sha256"), F.explode(F.array(signatures(F.col("edited"), chain))).alias("edited_sigs"))
    return rows.select(
        F.nullif(F.col("k"), F.lit(smallest)).alias("doc_id"), "n_chars", "edited_sha256", fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        jaccard(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), jaccard(F.col("sigs"), F.col("next_sigs")).alias("near_next"), F.size("sigs").cast("long").alias("n_signatures"),
    )


def op1_spotsigs(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
