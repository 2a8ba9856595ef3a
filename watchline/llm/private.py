"""Personal data by patterns, and information-theoretic sanitisation of the terms that give it away.

The values of the base patterns (addresses, cards, phone numbers) are the protected entities. How much a term, a word
or two words in a row, reveals of an entity is their pointwise mutual information as a share of the entity's own
information: 1 + log p(entity | term) / -log p(entity), which is 1 where the term occurs with the entity alone and 0
where it tells nothing. It is estimated over all texts: p(entity) from the texts that hold it, p(entity | term) from
the contexts in which the term stands near the entity and the texts in which the term occurs. Terms whose disclosure
is over a threshold are marked wherever they occur; in the text they are removed, and two words are generalised to the
one that discloses less, if it may stay.

Contexts are told apart by the words further round the entity, so that copies of a text, or of a passage, are one.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchline.llm.common import free_name, staged, steps, word_hashes
from watchline.llm.decontaminate import Bitmap, bitmap_of, digest

#: A term is disclosing from this share of an entity's information on, seen in so many contexts at least.
DISCLOSURE, CONTEXTS = 0.75, 3
#: Words to each side of an entity that count as near, and up to which its context is told from others.
NEAR, ROUND = 12, 30
#: Contexts of fewer words further round are told apart by the whole text.
FEW = 8
#: Distinct terms that a task counts, or rows that it holds, before it passes them on.
COUNTED, HELD = 300_000, 500

KINDS = ["email", "ip", "card", "phone", "term"]
# The base patterns. Those of emails and addresses are found in parts, so that long runs cost no more.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
TERM = re.compile(r"[^\W_]{3,}")

Span = tuple[int, int, int]


def emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping matches: each @ with the run before it and the domain behind it."""
    last, at = 0, text.find("@")
    low = 0
    while at >= 0:
        begun = max(low, last)
        start = at - LOCAL.match(text[begun:at][::-1]).end()
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield 0, start, found.end()
            last = found.end()
        low = at + 1
        at = text.find("@", max(low, last))


def addresses(text: str) -> Iterator[Span]:
    """Four numbers in a row of dotted ones, and the next four."""
    for run in DOTTED.finditer(text):
        if run[0].count(".") < 3:
            continue
        at, parts = run.start(), run[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                yield 1, at, end
            at = end + 1


def luhn(number: str) -> bool:
    doubled = [sum(divmod(2 * int(d), 10)) for d in number[-2::-2]]
    return (sum(map(int, number[-1::-2])) + sum(doubled)) % 10 == 0


def base(text: str) -> list[Span]:
    """Base matches as (kind's place in KINDS, start, end), by kind and start."""
    out = list(emails(text)) if "@" in text else []
    if DIGITS.search(text):
        if "." in text:
            out += addresses(text)
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                number = re.sub(r"[ -]", "", m[0])
                if 13 <= len(number) <= 19 and luhn(number):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGITS.findall(m[0])) <= 15]
    return out


def entity(text: str, span: Span) -> str:
    """The value of a base match, however it is written."""
    kind, start, end = span
    shown = text[start:end]
    return f"{KINDS[kind]}:{shown.lower() if kind == 0 else shown if kind == 1 else ''.join(DIGITS.findall(shown))}"


def without(text: str, spans: list[Span]) -> str:
    """The text in lower case with blanks for base matches; places stay."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower()[0] for c in text)
    if not spans:
        return low
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        out.append(low[at:start])
        out.append(" " * (end - max(at, start)))
        at = max(at, end)
    return "".join([*out, low[at:]])


def pairs(words: list[str]) -> Iterator[str]:
    return map(" ".join, zip(words, words[1:], strict=False))


def seed(value: str) -> int:
    """What xxhash64 gives for a string, as an unsigned number."""
    return xxhash.xxh64_intdigest(value.encode(), 42)


def passed(values: set[str], bitmap: Bitmap) -> set[str]:
    """Those of the values that the bitmap can't rule out."""
    some = list(values)
    there = bitmap.has(np.fromiter(map(seed, some), np.uint64, len(some)))
    return {some[i] for i in np.flatnonzero(there)}


def entities(rows: DataFrame) -> DataFrame:
    """``entity, th`` of each text's entities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            found: list[str] = []
            at: list[int] = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                own = {entity(text, s) for s in base(text)}
                found += own
                at += [i] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), batch.column("th").take(pa.array(at, pa.int64()))], names=["entity", "th"])

    return rows.mapInArrow(run, "entity string, th binary")


def contexts(rows: DataFrame, repeated: Bitmap) -> DataFrame:
    """``entity, context, terms`` of each text's entities that the bitmap has: the least hash of the words further
    round the entity in the text, and the terms near it."""
    shared = rows.sparkSession.sparkContext.broadcast(repeated)

    def of(text: str, th: bytes) -> Iterator[tuple[str, int, list[str]]]:
        spans = base(text)
        places = defaultdict(list)
        for s in spans:
            places[entity(text, s)].append(s[1])
        kept = passed(set(places), shared.value) if places else set()
        if not kept:
            return
        tokens = [(m.start(), m[0]) for m in TERM.finditer(without(text, spans))]
        starts, words = [a for a, _ in tokens], [w for _, w in tokens]
        distinct = list(set(words))
        hashed = dict(zip(distinct, word_hashes(distinct).view(np.int64).tolist(), strict=True))
        for value in sorted(kept):
            near: set[str] = set()
            beyond: set[str] = set()
            for start in places[value]:
                i = bisect_left(starts, start)
                for side in (words[max(0, i - NEAR) : i], words[i : i + NEAR]):
                    near.update(side, pairs(side))
                beyond.update(words[max(0, i - ROUND) : max(0, i - NEAR)], words[i + NEAR : i + ROUND])
            context = min(hashed[w] for w in beyond) if len(beyond) >= FEW else int.from_bytes(th[:8], "big", signed=True)
            yield value, context, sorted(near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in steps(batches):
            for text, th in zip(batch.column("text").to_pylist(), batch.column("th").to_pylist(), strict=True):
                for row in of(text, th):
                    held.append(row)
                    if len(held) >= HELD:
                        yield written(held)
                        held = []
        yield written(held)

    def written(held: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*held, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int64(), pa.list_(pa.string())], strict=True)], names=["entity", "context", "terms"])

    return rows.mapInArrow(run, "entity string, context long, terms array<string>")


def seeds(terms: DataFrame) -> DataFrame:
    """``seed`` of every term and of the words of two."""
    return terms.select(F.explode(F.array_distinct(F.array_append(F.split("term", " "), F.col("term")))).alias("part")).select(F.xxhash64("part").alias("seed"))


def terms_of(texts: list[str], wanted: Bitmap) -> list[set[str]]:
    """Each text's terms that the bitmap has; two words are put together only where it has both."""
    words = [TERM.findall(without(text, base(text))) for text in texts]
    sets = [set(w) for w in words]
    there = passed(set().union(*sets), wanted)
    both = [set(pairs_in(w, there)) if len(s & there) > 1 else set() for w, s in zip(words, sets, strict=True)]
    together = passed(set().union(*both), wanted)
    return [(s & there) | (b & together) for s, b in zip(sets, both, strict=True)]


def pairs_in(words: list[str], there: set[str]) -> Iterator[str]:
    return (f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if a in there and b in there)


def occurrences(rows: DataFrame, wanted: Bitmap, copied: Bitmap) -> DataFrame:
    """``th, terms, counts``: the terms that one bitmap has, counted over the task's texts, with no ``th``; or, for
    a text that the other can't rule out to have copies, its terms with its digest."""
    context = rows.sparkSession.sparkContext
    want, copy = context.broadcast(wanted), context.broadcast(copied)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in steps(batches):
            sets = terms_of(batch.column("text").to_pylist(), want.value)
            twice = copy.value.has(batch.column("seed").to_numpy().view(np.uint64))
            for own, several, th in zip(sets, twice, batch.column("th").to_pylist(), strict=True):
                if not several:
                    found.update(own)
                elif own:
                    yield row(th, own, None)
            if len(found) > COUNTED:
                yield row(None, found, found.values())
                found = Counter()
        yield row(None, found, found.values())

    def row(th, terms, counts) -> pa.RecordBatch:
        counts = pa.array([None if counts is None else list(counts)], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([th], pa.binary()), pa.array([list(terms)], pa.list_(pa.string())), counts], names=["th", "terms", "counts"])

    return rows.mapInArrow(run, "th binary, terms array<string>, counts array<long>")


def texts_with(rows: DataFrame, terms: DataFrame, copied: Bitmap) -> DataFrame:
    """``term, n``: in how many different texts each of ``terms`` (term) occurs; others may come with it."""
    parts = seeds(terms).distinct()
    wanted = bitmap_of(parts, parts.count())
    found = staged(occurrences(rows, wanted, copied))
    once = found.where("th IS NULL").select(F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("counts").alias("n"))).alias("x")).select("x.term", "x.n")
    of_copies = found.where("th IS NOT NULL").dropDuplicates(["th"]).select(F.explode("terms").alias("term"), F.lit(1).cast("long").alias("n"))
    return once.union(of_copies).groupBy("term").agg(F.sum("n").alias("n"))


def disclosures(docs: DataFrame, least: int = CONTEXTS) -> DataFrame:
    """``entity, term, disclosure`` of all terms that stand near an entity in ``least`` contexts or more."""
    rows = docs.where("text <> ''").select("text", digest().alias("th")).withColumn("seed", F.xxhash64("th"))
    texts = rows.groupBy("th", "seed").agg(F.count("*").alias("n"))
    total, copies = texts.agg(F.count("*"), F.count_if(F.col("n") > 1)).first()
    copied = bitmap_of(texts.where("n > 1").select("seed"), copies)
    of_entity = staged(entities(rows).distinct().groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= least))
    repeated = bitmap_of(of_entity.select(F.xxhash64("entity").alias("seed")), of_entity.count())
    near = contexts(rows, repeated).select("entity", "context", F.explode("terms").alias("term")).distinct()
    near = staged(near.groupBy("entity", "term").agg(F.count("*").alias("n_near")).where(F.col("n_near") >= least).join(of_entity, "entity"))
    met = near.join(texts_with(rows, near.select("term").distinct(), copied).withColumnRenamed("n", "n_term"), "term")
    known = F.log(F.lit(float(total)) / F.col("n_entity"))
    share = F.least(F.lit(1.0), F.col("n_near") / F.col("n_term"))
    # An entity in all texts has no information to disclose.
    return met.select("entity", "term", F.when(known > 0, 1 + F.log(share) / known).otherwise(0.0).alias("disclosure"))


def disclosing(docs: DataFrame, threshold: float = DISCLOSURE, least: int = CONTEXTS) -> DataFrame:
    """``term, keep`` of the terms over the threshold for some entity: ``keep`` is 1 or 2 where that word of two may
    stay, as it discloses less than the threshold and less than the other, else 0."""
    most = staged(disclosures(docs, least).groupBy("term").agg(F.max("disclosure").alias("d")))
    found = most.where(F.col("d") >= threshold).select("term", F.split("term", " ").alias("words"))
    of = lambda k: most.select(F.col("term").alias(f"w{k}"), F.col("d").alias(f"d{k}"))
    met = found.withColumns({"w1": F.col("words")[0], "w2": F.get("words", F.lit(1))}).join(of(1), "w1").join(of(2), "w2", "left")
    first = (F.col("d1") < threshold) & (F.col("d1") <= F.col("d2"))
    return met.select("term", F.when(F.col("d2").isNull(), 0).when(first, 1).when(F.col("d2") < threshold, 2).otherwise(0).alias("keep"))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end in spans)


def located(rows: DataFrame, wanted: Bitmap) -> DataFrame:
    """Each row of ``rows`` (doc_id, th, text) with its base counts and ``spans``, and a row without them for each place
    ``term, start, end`` of a term that the bitmap has."""
    shared = rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            shown = [t or "" for t in batch.column("text").to_pylist()]
            spans = [base(t) for t in shown]
            own = list(range(len(shown)))
            counts = [pa.array([sum(k == kind for k, _, _ in s) for s in spans], pa.int64()) for kind in range(4)]
            yield out(batch, own, [*counts, pa.array(map(listed, spans), pa.string()), *(pa.nulls(len(own), t) for t in types)])
            for i, (text, s, terms) in enumerate(zip(shown, spans, terms_of(shown, shared.value), strict=True)):
                if terms:
                    hits = list(places(without(text, s), terms))
                    for at in range(0, len(hits), 10_000):
                        columns = list(zip(*hits[at : at + 10_000], strict=True))
                        yield out(batch, [i] * len(columns[0]), [*(pa.nulls(len(columns[0]), t) for t in [pa.int64()] * 4 + [pa.string()]), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))])

    def out(batch: pa.RecordBatch, row: list[int], columns: list[pa.Array]) -> pa.RecordBatch:
        take = pa.array(row, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("th").take(take), *columns], names=names)

    types = [pa.string(), pa.int64(), pa.int64()]
    names = ["doc_id", "th", *(f"n_{k}" for k in KINDS[:4]), "spans", "term", "start", "end"]
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, th binary, n_email long, n_ip long, n_card long, n_phone long, spans string, term string, start long, end long")


def places(low: str, wanted: set[str]) -> Iterator[tuple[str, int, int]]:
    before = None
    for m in TERM.finditer(low):
        if m[0] in wanted:
            yield m[0], m.start(), m.end()
        if before and (both := f"{before[0]} {m[0]}") in wanted:
            yield both, before.start(), m.end()
        before = m


def found_in(docs: DataFrame, threshold: float, least: int) -> DataFrame:
    """``doc_id, th, copies``, the base counts and ``base`` spans of each text under an id, and its ``terms`` (start, end, keep)."""
    marked = staged(disclosing(docs, threshold, least))
    parts = seeds(marked).distinct()
    wanted = bitmap_of(parts, parts.count())
    rows = located(docs.select("doc_id", digest().alias("th"), "text"), wanted).join(marked, "term", "left")
    hit = F.when(F.col("keep").isNotNull(), F.struct("start", "end", "keep"))
    return rows.groupBy("doc_id", "th").agg(
        F.count("spans").alias("copies"),
        *(F.max(f"n_{k}").alias(f"n_{k}") for k in KINDS[:4]),
        F.max("spans").alias("base"),
        F.array_sort(F.collect_set(hit)).alias("terms"),
    )


def scan(docs: DataFrame, threshold: float = DISCLOSURE, least: int = CONTEXTS) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms`` of each row.

    ``spans`` are those of the base kinds, then disclosing terms as ``term:start:end``, in code points, ends exclusive;
    terms may overlap each other, not base matches. Null and empty texts have none. What is learnt counts each text
    once, however often it occurs, under whatever id. Repeated rows come back as often as they are there; other columns
    are left out.
    """
    rows = found_in(docs, threshold, least)
    terms = F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"], t["end"]))
    joined = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.size("terms") > 0, F.array_join(terms, ",")))
    out = rows.select("doc_id", *(f"n_{k}" for k in KINDS[:4]), F.sha2(F.col("base"), 256).alias("base_sha256"), joined.alias("spans"), F.size("terms").cast("long").alias("n_terms"), "copies")
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")


def replaced(text: str, spans: str, terms: list[dict]) -> str:
    """The text with base matches by their kind, single terms removed, and the word that may stay of two."""
    found = [(int(a), int(b), f"[{k.upper()}]") for k, a, b in (s.split(":") for s in spans.split(",") if s)]
    for t in terms:
        words = TERM.findall(text[t["start"] : t["end"]]) if t["keep"] else []
        found.append((t["start"], t["end"], words[t["keep"] - 1] if words else "[TERM]"))
    out, at = [], 0
    for start, end, instead in sorted(found, key=lambda x: (x[0], -x[1])):
        if start >= at:
            out += [text[at:start], instead]
        elif end > at:
            out.append("[TERM]")  # what a match leaves over of another goes too
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame, threshold: float = DISCLOSURE, least: int = CONTEXTS) -> DataFrame:
    """``docs``, all columns, with personal data and disclosing terms generalised or removed in ``text``, n_chars to match.

    Null texts stay null; repeated rows stay as often as they are there.
    """
    th, base_spans, terms = (free_name(docs) + suffix for suffix in "hbt")
    found = found_in(docs.select(F.lit(0).alias("doc_id"), "text"), threshold, least).where("base <> '' OR size(terms) > 0")
    found = found.select(F.col("th").alias(th), F.col("base").alias(base_spans), F.col("terms").alias(terms))
    joined = docs.withColumn(th, digest()).join(found, th, "left")
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            shown = batch.column("text").to_pylist()
            clean = [t if b is None else replaced(t, b, x) for t, b, x in zip(shown, batch.column(base_spans).to_pylist(), batch.column(terms).to_pylist(), strict=True)]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(clean, pa.string())).select(columns)

    out = joined.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
