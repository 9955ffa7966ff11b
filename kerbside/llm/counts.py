"""Token counts: pieces are counted once for each distinct pre-token.

The vocabulary's normaliser and pre-tokenizer never join characters across
white space, so a text's runs of visible characters are counted apart: the
whole corpus is first reduced to its distinct runs with their frequencies,
the library counts the pieces of each run once, and a document's count is the
sum over its runs of frequency times pieces.  The most frequent runs (a fixed
number of rows) are broadcast; the long tail is joined by key, after those
runs that could make a key hot have been taken out.  No ids are kept.

Null texts count as empty, with no tokens.  Rows are numbered by no id:
repeated rows give equal rows, and every input row has a result row.  Texts
that hold one of the vocabulary's special strings are counted by the library
as a whole.  An empty table gives no rows.  Only doc_id and text are read.
"""

from __future__ import annotations

import os
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import materialise

#: Rows of the broadcast part of the table of runs: about 2 MB, at any size of the corpus.
HOT_RUNS = 100_000
#: A task hands its counts on when it has so many distinct runs.
FLUSH_RUNS = 400_000
#: Runs longer than this are not worth a row in the table of runs.
LONG_RUN = 200

_TOKENIZERS: dict = {}


def tokenizer(path: str):
    """A function from a list of texts to their numbers of tokens, and the vocabulary's special strings."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            _TOKENIZERS[path] = (lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)], None)
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            specials = [x.content for x in t.get_added_tokens_decoder().values()]
            _TOKENIZERS[path] = (lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)], specials)
    return _TOKENIZERS[path]


def _plain(text: str, specials) -> bool:
    return specials is not None and not any(s in text for s in specials)


def distinct_runs(docs: DataFrame, path: str) -> DataFrame:
    """(run, freq) over all texts."""

    def count(batches):
        _, specials = tokenizer(path)
        seen: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["run", "freq"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text and _plain(text, specials):
                    seen.update(x for x in text.encode().split() if len(x) <= LONG_RUN)
                    if len(seen) > FLUSH_RUNS:
                        yield rows()
                        seen.clear()
        if seen:
            yield rows()

    return docs.select("text").mapInArrow(count, "run binary, freq long").groupBy("run").agg(F.sum("freq").alias("freq"))


def count_pieces(runs: DataFrame, path: str) -> DataFrame:
    """The table of runs with the number of pieces of each."""

    def pieces(batches):
        count, _ = tokenizer(path)
        for batch in batches:
            n = count([x.decode() for x in batch.column("run").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("run"), batch.column("freq"), pa.array(n, pa.int32())], ["run", "freq", "pieces"])

    return runs.mapInArrow(pieces, "run binary, freq long, pieces int")


def least_hot(table: DataFrame, most: int) -> int:
    """The frequency from which runs are hot, so that there are ``most`` of them at most.

    Runs are counted by the leading bits of their frequency, so a few hundred
    rows tell the frequency; no task sorts or gathers runs.
    """
    bits = F.length(F.bin("freq"))
    lead = F.greatest(bits - 4, F.lit(0))
    step = F.expr("shiftleft(shiftright(freq, lead), lead)")
    steps = table.withColumn("lead", lead).groupBy(step.alias("least")).agg(F.count("*").alias("n"))
    hot, least = 0, None
    for r in sorted(steps.collect(), key=lambda r: -r["least"]):  # 16 rows for each power of two at most
        hot += r["n"]
        if hot > most:
            break
        least = r["least"]
    return 1 << 62 if least is None else least


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, hot_runs: int = HOT_RUNS) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for each row of ``docs``."""
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    table = materialise(count_pieces(distinct_runs(docs, tokenizer_path), tokenizer_path))
    top = table.where(F.col("freq") >= least_hot(table, hot_runs)).select("run", "pieces").toArrow()
    hot = spark.sparkContext.broadcast(dict(zip(top.column("run").to_pylist(), top.column("pieces").to_pylist())))

    def split(batches):
        from pyspark import TaskContext

        count, specials = tokenizer(tokenizer_path)
        known, row = hot.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("row", "n_bytes", "known", "runs", "freqs")}
            for text in batch.column("text").to_pylist():
                raw = (text or "").encode()
                total, runs, freqs = 0, [], []
                if not _plain(text or "", specials):
                    total = count([text])[0] if text else 0
                else:
                    for run, freq in Counter(raw.split()).items():
                        if (n := known.get(run)) is not None:
                            total += n * freq
                        elif len(run) > LONG_RUN:
                            total += count([run.decode()])[0] * freq
                        else:
                            runs.append(run)
                            freqs.append(freq)
                for k, v in zip(out, (row, len(raw), total, runs, freqs)):
                    out[k].append(v)
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(out["row"], pa.int64()), batch.column("doc_id"), pa.array(out["n_bytes"], pa.int64()), pa.array(out["known"], pa.int64()), pa.array(out["runs"], pa.list_(pa.binary())), pa.array(out["freqs"], pa.list_(pa.int32()))], ["row", "doc_id", "n_bytes", "known", "runs", "freqs"])

    schema = f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, known long, runs array<binary>, freqs array<int>"
    per_doc = materialise(docs.mapInArrow(split, schema))  # one write fixes the rows' numbers
    tail = per_doc.select("row", F.explode(F.arrays_zip("runs", "freqs")).alias("x")).select("row", F.col("x.runs").alias("run"), F.col("x.freqs").alias("n"))
    rest = tail.join(table.select("run", "pieces"), "run").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("rest"))
    total = F.col("known") + F.coalesce("rest", F.lit(0))
    return per_doc.select("row", "doc_id", "n_bytes", "known").join(rest, "row", "left").select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
