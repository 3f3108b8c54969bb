"""Documents to chunks: windows, sections, facts attached to chunks, ids, postings, sync."""

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerscope.functions.text import canonical_url_offer, fold_text, stable_digest

CHUNKS = "doc_id long, chunk_index int, section string, content string, n_words int"
_END = re.compile(r"[.!?;][\"')]*$")


def clean_source_text(text: str) -> str:
    """HTML entities and line ends made plain, spaces squeezed in each line, runs of blank lines as one."""
    lines = [re.sub(r"[ \t\xa0]+", " ", x).strip() for x in html.unescape(text).replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def is_heading(line: str) -> bool:
    """Markdown, trailing colon, capitals, or title case, in 12 words and 140 characters at most."""
    words = line.split()
    if not words or len(line) > 140 or len(words) > 12:
        return False
    if line.startswith("#") or line.endswith(":"):
        return True
    letters = [c for c in line if c.isalpha()]
    if line[-1] in ".!?;," or not letters:
        return False
    return all(c.isupper() for c in letters) or (len(words) > 1 and all(w[0].isupper() for w in words if w[0].isalpha()))


def sections(text: str, least: int = 24) -> list[tuple[str, str]]:
    """(chain of the last three headings, body); a neighbour is merged unless both have `least` words."""
    chain: list[str] = []
    found: list[tuple[str, list[str]]] = []
    for line in text.split("\n"):
        line = line.strip()
        if is_heading(line):
            chain = [*chain, line.strip("# :")][-3:]
            found.append((" > ".join(chain), []))
        elif line:
            if not found:
                found.append(("", []))
            found[-1][1].append(line)
    merged: list[tuple[str, str]] = []
    for head, body in ((h, " ".join(b)) for h, b in found):
        if merged and (len(body.split()) < least or len(merged[-1][1].split()) < least):
            merged[-1] = (merged[-1][0] or head, " ".join(x for x in (merged[-1][1], body) if x))
        else:
            merged.append((head, body))
    return [m for m in merged if m[1]]


def word_windows(words: list[str], most: int, overlap: int) -> Iterator[list[str]]:
    """Windows that end at the last sentence end after 65 % of their length; the next begins `overlap` words before."""
    at = 0
    while at < len(words):
        end = min(len(words), at + most)
        if end < len(words):
            for j in range(end - 1, at + int(most * 0.65) - 1, -1):
                if _END.search(words[j]):
                    end = j + 1
                    break
        yield words[at:end]
        if end >= len(words):
            return
        at = max(end - overlap, at + 1)


def chunk_documents(docs: DataFrame, most: int = 220, overlap: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunks of each document; one streaming pass, as sections and breaks are found in sequence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, t in zip(batch["doc_id"], batch["text"], strict=True):
                n = 0
                for head, body in sections(clean_source_text(t or "")):
                    for w in word_windows(body.split(), most, overlap):
                        rows.append((doc, n, head, " ".join(w), len(w)))
                        n += 1
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "section", "content", "n_words"])

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, CHUNKS.replace("doc_id long", f"doc_id {docs.schema[key].dataType.simpleString()}"))


def char_windows(docs: DataFrame, size: int, overlap: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_index, chars) of plain windows of `size` characters with an overlap, native."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - F.lit(overlap), F.lit(1)), F.lit(size - overlap))
    return docs.filter(F.length(text) > 0).select(key, text, F.posexplode(starts).alias("chunk_index", "at")).select(key, "chunk_index", F.substring(F.col(text), F.col("at"), F.lit(size)).alias("chars"))


#: Where a window may end, and the share of its length from which on.
BREAKS, FROM = ("\n", ". ", "; "), 0.65
_EDGES = " \t\n\x0b\f\r"


def cuts(text: str, size: int, overlap: int) -> Iterator[str]:
    """Windows of at most `size` characters, each ending at the last break after FROM of its length, if there is one.

    The next window begins after the first space in the last `overlap` characters, so its place depends on the last one's break.
    """
    text, at = text.strip(_EDGES), 0
    while at < len(text):
        end, least = at + size, at + int(size * FROM)
        if end >= len(text):
            yield text[at:]
            return
        stop = max(text.rfind(b, least, end) for b in BREAKS)
        end = stop + 1 if stop >= 0 else end
        yield text[at:end]
        after = max(end - overlap, at + 1)
        space = text.find(" ", after, end + 1)
        at = space + 1 if space >= 0 else after


def text_windows(docs: DataFrame, size: int, overlap: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_index, chars) of windows that end at sentences and lines; one pass over texts of any length. Blank windows don't count, nor null texts."""
    if not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in enumerate(batch.column(1)):
                found = [w for w in (c.strip(_EDGES) for c in cuts(t.as_py() or "", size, overlap)) if w]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[i], len(found)), pa.array(range(len(found)), pa.int32()), pa.array(found, pa.string())], names=[key, "chunk_index", "chars"])

    return docs.select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, chunk_index int, chars string")


def token_windows(docs: DataFrame, most: int = 384, overlap: int = 64, header: int = 64, key: str = "doc_id", text: str = "text", title: str = "title") -> DataFrame:
    """Windows of words, each with the title's words (at most `header`) before it; native expressions only."""
    words = F.filter(F.split(text, "[ \\t\\n\\r]+"), lambda w: w != "")
    head = F.slice(F.filter(F.split(title, "[ \\t\\n\\r]+"), lambda w: w != ""), 1, header)
    rows = docs.select(key, words.alias("w"), head.alias("h")).filter(F.size("w") > 0)
    room = F.greatest(F.lit(most) - F.size("h"), F.lit(overlap + 1))
    rows = rows.select(key, "w", "h", room.alias("room"))
    last = F.greatest(F.size("w") - F.lit(overlap), F.lit(1))
    rows = rows.select(key, "w", "h", "room", F.posexplode(F.sequence(F.lit(1), last, F.col("room") - F.lit(overlap))).alias("chunk_index", "at"))
    body = F.expr("slice(w, at, room)")
    return rows.select(key, "chunk_index", F.array_join(F.concat("h", body), " ").alias("content"), F.size(body).alias("n_body"))


def attach_facts(chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """(doc_id, fact_type, evidence, chunk_index): the chunk that holds the evidence with the widest margin on both sides.

    Ties go to the lowest index; facts whose evidence is in no chunk go.
    """
    c, e = fold_text("content"), fold_text("evidence")
    rows = chunks.select("doc_id", "chunk_index", c.alias("c")).join(facts.select("doc_id", "fact_type", "evidence", e.alias("e")).filter("e <> ''"), "doc_id").withColumn("at", F.instr(F.col("c"), F.col("e"))).filter("at > 0")
    margin = F.least(F.col("at") - 1, F.length("c") - F.length("e") - F.col("at") + 1)
    w = Window.partitionBy("doc_id", "fact_type", "evidence").orderBy(F.desc("margin"), "chunk_index")
    return rows.withColumn("margin", margin).withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("doc_id", "fact_type", "evidence", "chunk_index", "margin")


def chunk_id(scope: Column, doc: Column, index: Column, content: Column) -> Column:
    return stable_digest(scope, doc, index, F.sha2(content, 256))


def offer_boundary(facts: DataFrame, marks: tuple[str, ...]) -> DataFrame:
    """(doc_id, boundary): digest of a document's sorted identity facts, whose type contains one of the marks."""
    own = facts.filter(F.col("fact_type").rlike("|".join(marks)))
    return own.groupBy("doc_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "fact_type", "fact_text"))), "\x1f"), 256).alias("boundary"))


def embedding_context(title: Column, bank: Column, product: Column, section: Column, content: Column) -> Column:
    """Fixed lines in front of a chunk's text."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(c, F.lit("-")))
    return F.concat_ws("\n", line("Title", title), line("Bank", bank), line("Product", product), line("Section", section), F.lit("Content:"), content)


def weighted_postings(rows: DataFrame, fields: dict[str, str], key: str = "doc_id") -> DataFrame:
    """(key, term, weight, tf): accent-folded terms of fields with weights A to C.

    All terms of a row are in it, so they are counted where it is read, without a shuffle; the key is unique to a row.
    """
    folded = [F.trim(F.regexp_replace(fold_text(c), "[^a-z0-9]+", " ")).alias(f"field{i}") for i, c in enumerate(fields)]
    weights = list(fields.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 200):
                part, at, terms, weight, tf = batch.slice(lo, 200), [], [], [], []
                for i in range(len(part)):
                    for w in sorted(set(weights)):
                        said = Counter(t for f, own in enumerate(weights, 1) if own == w for t in (part.column(f)[i].as_py() or "").split())
                        at += [i] * len(said)
                        terms += said.keys()
                        weight += [w] * len(said)
                        tf += said.values()
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array(terms, pa.string()), pa.array(weight, pa.string()), pa.array(tf, pa.int64())], names=[key, "term", "weight", "tf"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, *folded).mapInArrow(run, f"{key} {kind}, term string, weight string, tf long")


def offer_id(bank: Column, product: Column, url: Column, title: Column, boundary: Column, start: Column, end: Column) -> Column:
    """Digest of what makes an offer: bank, product, canonical address, title, identity facts and days."""
    return stable_digest(bank, product, canonical_url_offer(url), title, boundary, start.cast("string"), end.cast("string"))


def sync_chunks(desired: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows after the sync, stale ids): desired chunks replace those of the same documents; other documents stay."""
    touched = desired.select("doc_id").distinct()
    stale = existing.join(touched, "doc_id", "left_semi").join(desired.select("chunk_id").distinct(), "chunk_id", "left_anti").select("chunk_id")
    kept = existing.join(touched, "doc_id", "left_anti")
    return kept.unionByName(desired), stale


def pending_embeddings(snaps: DataFrame, chunks: DataFrame, force: bool = False) -> DataFrame:
    """Searchable snapshots without an embedded chunk."""
    rows = snaps.filter("searchable")
    return rows if force else rows.join(chunks.select("snap_id").distinct(), "snap_id", "left_anti")
