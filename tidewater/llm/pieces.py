"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece of a model has a character before a white-space marker, merges never cross into
a marker from the left. A text is then a row of marked words that are segmented apart, and a distinct
marked word needs segmenting once. There are two tables of distinct words.

The table of a task (the default): words new to it are segmented in one call, and ids are joined back to
each text by position. It starts afresh beyond ``TABLE_WORDS`` words, so its memory is bounded while
results stay the same. Nothing is shuffled; a word is segmented once a task.

The table of the corpus (``corpus_table``): Spark counts the words of all texts and segments each distinct
one once. The ``HEAD`` most frequent words of up to ``WORD_CHARS`` characters, a bounded part, are
broadcast and joined back by position in the task. Other words leave as (row, position, word), meet the table
in a join, and go back to their row by position, with the row's text. That moves every text with a rare
word; the README has its figures.

A model for which the condition fails is run over whole texts instead.

Results equal the library's ``encode`` (no begin or end ids, no sampling) and ``decode(ids)``.

Defined results: a null text is empty; an empty text has no ids; a text of any length is one row, and one
without white space is one word of the table; repeated rows each get a row; words of equal count are in the
head together or not at all; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewater.llm.shared import stage

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Words that are broadcast with their ids, and characters of one at most: below 50 MB in all.
HEAD, WORD_CHARS = 200_000, 40
#: Words of a task's table.
TABLE_WORDS = 250_000
#: Different words a task counts before it passes them on.
COUNTED = 200_000
#: A run of markers and what follows it.
_MARKED = re.compile(f"{MARK}+[^{MARK}]*")


class Segmenter:
    """The library's model, and whether it segments marked words apart."""

    def __init__(self, model: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=model if "/" in model else public_tokenizers.path(model))

    def apart(self) -> bool:
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        probe = "ﬁ①  a "
        return all(MARK not in p.lstrip(MARK) for p in pieces) and self.model.normalize(probe) == MARK + probe.replace(" ", MARK)

    def segmented(self, words: list[str]) -> Iterator[tuple[str, str]]:
        """(ids as decimals with commas, decoded text) of marked words without their first marker."""
        for word, ids in zip(words, self.model.encode(words, num_threads=1) if words else [], strict=True):
            if not word:  # a lone marker, which the library drops only if nothing stands before it
                ids = [self.model.piece_to_id(MARK)]
            yield ",".join(map(str, ids)), self.model.decode(ids)


def chunks(text: str) -> list[str]:
    """Marked words, without their first marker."""
    if not text:
        return []
    if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
        return [x[1:] for x in _MARKED.findall(MARK + text.replace(" ", MARK))]
    return text.split(" ")


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over a column ``_text``: tasks count first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
        for b in batches:
            for text in b.column(0):
                counts.update(chunks(text.as_py() or ""))
                if len(counts) > COUNTED:
                    yield out()
                    counts.clear()
        yield out()

    return texts.select("_text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def chunk_table(counts: DataFrame, model: str) -> DataFrame:
    """(word, c, ids, plain): each distinct word segmented once; ``plain`` is null where it equals the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Segmenter(model)
        for b in batches:
            words = b.column(0).to_pylist()
            got = list(one.segmented(words))
            plain = [None if p == w else p for w, (_, p) in zip(words, got, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in got], pa.string()), pa.array(plain, pa.string())], ["word", "c", "ids", "plain"])

    return counts.mapInArrow(run, "word string, c long, ids string, plain string")


def _texts(column: pa.Array) -> Iterator[list[str]]:
    """Runs of texts of a few MB."""
    run, size = [], 0
    for x in column:
        text = x.as_py() or ""
        run.append(text)
        size += len(text)
        if size > 2_000_000:
            yield run
            run, size = [], 0
    if run:
        yield run


class TaskTable:
    """Marked words to their ids and decoded text, as far as a task has met them."""

    def __init__(self, model: str, limit: int) -> None:
        self.segmenter, self.limit = Segmenter(model), limit
        self.ids: dict[str, str] = {}
        self.plain: dict[str, str] = {}

    def encode(self, texts: list[str]) -> list[tuple[str, str]]:
        """(ids as decimals with commas, decoded text) of each text."""
        split = [chunks(t) for t in texts]
        if len(self.ids) > self.limit:
            self.ids, self.plain = {}, {}
        new = list(set().union(*split).difference(self.ids))
        for word, (ids, plain) in zip(new, self.segmenter.segmented(new), strict=True):
            self.ids[word], self.plain[word] = ids, word if plain == word else plain
        ids, plain = self.ids.__getitem__, self.plain.__getitem__
        return [(",".join(map(ids, x)), " ".join(map(plain, x))) for x in split]


Finish = Callable[[list[tuple[str, str]]], list[pa.Array]]


def _encoded(docs: DataFrame, id_col: str, text_col: str, model: str, corpus_table: bool, shape: str, finish: Finish) -> DataFrame:
    """One row a document: its id and the columns ``shape`` that ``finish`` makes of (ids with commas, decoded text)."""
    names, id_type = [x.split()[0] for x in shape.split(", ")], docs.schema[id_col].dataType.simpleString()
    slim = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"))

    limit, apart = TABLE_WORDS, Segmenter(model).apart()

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = TaskTable(model, limit)
        library = one.segmenter.model
        for b in batches:
            at = 0
            for texts in _texts(b.column(1)):
                coded = one.encode(texts) if apart else [(",".join(map(str, ids)), library.decode(ids)) for ids in map(library.encode, texts)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), *finish(coded)], [id_col, *names])
                at += len(texts)

    if not (apart and corpus_table):
        return slim.mapInArrow(alone, f"`{id_col}` {id_type}, {shape}")
    table = stage(chunk_table(word_counts(slim), model), "chunks")
    short = F.length("word") <= WORD_CHARS
    above = table.filter(short).groupBy("c").count().withColumn("words", F.sum("count").over(W.orderBy(F.desc("c")))).filter(F.col("words") <= HEAD).agg(F.min("c")).first()[0]
    in_head = short & (F.col("c") >= (above or 2**62))
    head = docs.sparkSession.sparkContext.broadcast(table.filter(in_head).select("word", "ids", "plain").toArrow())

    def known() -> tuple[dict[str, str], dict[str, str]]:
        words, ids, plain = (c.to_pylist() for c in head.value.columns)
        return dict(zip(words, ids, strict=True)), {w: w if p is None else p for w, p in zip(words, plain, strict=True)}

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts of head words are done; others keep their text and list what is missing."""
        ids, plain = known()
        for b in batches:
            at = 0
            for texts in _texts(b.column(2)):
                coded, missing = [], []
                for text in texts:
                    x = chunks(text)
                    try:
                        coded.append((",".join([ids[w] for w in x]), " ".join([plain[w] for w in x])))
                        missing.append(None)
                    except KeyError:
                        coded.append(("", ""))
                        missing.append([{"position": k, "word": w} for k, w in enumerate(x) if w not in ids])
                lists = pa.array(missing, pa.list_(pa.struct([("position", pa.int32()), ("word", pa.string())])))
                kept = pa.array([t if m else None for t, m in zip(texts, missing, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(at, len(texts)) for i in (0, 1)), kept, lists, *finish(coded)], ["_id", "_row", "_text", "_missing", *names])
                at += len(texts)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, plain = known()
        for b in batches:
            at = 0
            for texts in _texts(b.column(1)):
                coded = []
                for text, found in zip(texts, b.column(2).slice(at, len(texts)).to_pylist(), strict=True):
                    x = chunks(text)
                    here = {y["position"]: y for y in found}
                    coded.append((",".join([here[k]["ids"] if k in here else ids[w] for k, w in enumerate(x)]), " ".join([(w if here[k]["plain"] is None else here[k]["plain"]) if k in here else plain[w] for k, w in enumerate(x)])))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), *finish(coded)], [id_col, *names])
                at += len(texts)

    rows = slim.select("_id", F.monotonically_increasing_id().alias("_row"), "_text")
    done = stage(rows.mapInArrow(first, f"_id {id_type}, _row long, _text string, _missing array<struct<position:int,word:string>>, {shape}"), "coded")
    left = done.filter("_missing is not null")
    words = left.select("_row", F.explode("_missing").alias("_m")).select("_row", "_m.position", "_m.word")
    found = words.join(table.filter(~in_head).select("word", "ids", "plain"), "word").groupBy("_row").agg(F.collect_list(F.struct("position", "ids", "plain")).alias("_found"))
    rest = left.select("_id", "_row", "_text").join(found, "_row").select("_id", "_text", "_found").mapInArrow(second, f"`{id_col}` {id_type}, {shape}")
    return done.filter("_missing is null").select(F.col("_id").alias(id_col), *names).union(rest)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, corpus_table: bool = False) -> DataFrame:
    """(id, ids, decoded) of each document; ``model`` is a file name of the public tokenizers, or a path every executor has."""
    ids = lambda csv: [int(x) for x in csv.split(",")] if csv else []
    return _encoded(docs, id_col, text_col, model, corpus_table, "ids array<int>, decoded string", lambda coded: [pa.array([ids(x) for x, _ in coded], pa.list_(pa.int32())), pa.array([d for _, d in coded], pa.string())])


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """(id, text) from ids; null ids give an empty text."""
    slim = encoded.select(encoded[id_col].alias("_id"), encoded[ids_col].cast("array<int>").alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Segmenter(model).model
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([one.decode(x.as_py() or []) for x in b.column(1)], pa.string())], [id_col, "text"])

    return slim.mapInArrow(run, f"`{id_col}` {slim.schema['_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, corpus_table: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): the same encoding, without sending the ids out of the task."""
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()

    def finish(coded: list[tuple[str, str]]) -> list[pa.Array]:
        return [pa.array([x.count(",") + 1 if x else 0 for x, _ in coded], pa.int64()), pa.array([sha(x) for x, _ in coded], pa.string()), pa.array([sha(d) for _, d in coded], pa.string())]

    return _encoded(docs, id_col, text_col, model, corpus_table, "n_tokens long, ids_sha256 string, decoded_sha256 string", finish)
