"""How many survivors hold a deleted content or one of its strong words, without a row for each pair.

Survivors are numbered, and a word's postings are lists of places within blocks of BLOCK numbers. A delete's count in a block is the
size of the union of its words' lists, which is marked in an array of BLOCK flags. Words are found by the inverted index of
residue_index (strong words as substrings of the vocabulary); whole contents are verified in the texts, once for each distinct content.

The count is of pairs, so it looks at each delete in each block: that part grows with the square of the input, but by one
array operation for BLOCK pairs. A task holds the lists of one block for at most some CHUNK deletes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarden.functions import residue_text as R
from tidewarden.functions.identity import trimmed
from tidewarden.operators import residue_index
from tidewarden.operators.residue_index import RAW, Index, pieces
from tidewarden.sources.shared import written

#: Survivors of a block (places fit 16 bits), and deletes of a chunk on average.
BLOCK, CHUNK = 1 << 15, 4096
_BITS = BLOCK.bit_length() - 1


def block_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, block and places of each word between white space of some texts (pid, survivor); a batch's lists are in order."""
    for b in batches:
        if not b.num_rows:
            continue
        pid = b.column("pid").to_numpy()
        lists = pc.ascii_split_whitespace(b.column("survivor"))
        flat = lists.flatten().dictionary_encode()
        blocks, block = np.unique(pid >> _BITS, return_inverse=True)
        row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
        n = max(1, len(flat.dictionary))
        pairs = np.unique((block[row] * n + flat.indices.to_numpy()) * b.num_rows + row)
        key, row = np.divmod(pairs, b.num_rows)
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        at = pa.array((pid[row] & (BLOCK - 1)).astype(np.int16))
        places = pa.ListArray.from_arrays(pa.array(np.append(starts, len(key)).astype(np.int32)), at)
        out = pa.RecordBatch.from_arrays([flat.dictionary.take(pa.array(key[starts] % n)), pa.array(blocks[key[starts] // n]), places], ["word", "block", "at"])
        yield out.filter(pc.not_equal(out.column(0), ""))


def _counted(lists: pa.Table, deletes: pa.Table) -> pa.Table:
    """del_seq, n and longest of the deletes of a chunk in one block. lists: id, at, whole; deletes: del_seq, size, whole, ids, sizes."""
    out: list[tuple[int, int, int]] = []
    lists = lists.combine_chunks().sort_by("id")
    deletes = deletes.combine_chunks()
    if lists.num_rows and deletes.num_rows:
        known = []
        for whole in (False, True):
            mine = lists.filter(pc.equal(lists["whole"], whole)).combine_chunks()
            at = mine["at"].combine_chunks() if mine.num_rows else pa.array([], pa.list_(pa.int16()))
            ids, first = np.unique(mine["id"].to_numpy(), return_index=True)
            ends = np.append(0, np.cumsum(pc.list_value_length(at).to_numpy(zero_copy_only=False)))
            known.append((ids, ends[first], ends[np.append(first[1:], mine.num_rows)] if len(first) else ends[:0], at.flatten().to_numpy().astype(np.int64)))
        (ids, start, end, places), (whole_ids, whole_start, whole_end, whole_places) = known
        whole_at = {k: slice(s, e) for k, s, e in zip(whole_ids.tolist(), whole_start.tolist(), whole_end.tolist(), strict=True)}
        asked = deletes["ids"].combine_chunks()
        bounds = np.append(0, np.cumsum(pc.list_value_length(asked).to_numpy(zero_copy_only=False)))
        wanted, sizes = asked.flatten().to_numpy(), deletes["sizes"].combine_chunks().flatten().to_numpy()
        row = np.minimum(np.searchsorted(ids, wanted), max(0, len(ids) - 1))
        there = ids[row] == wanted if len(ids) else np.zeros(len(wanted), bool)
        mark = np.zeros(BLOCK, bool)
        for i, (seq, size, whole) in enumerate(zip(deletes["del_seq"].to_pylist(), deletes["size"].to_pylist(), deletes["whole"].to_pylist(), strict=True)):
            mine = np.flatnonzero(there[bounds[i] : bounds[i + 1]]) + bounds[i]
            full = whole_places[whole_at[whole]] if whole in whole_at else whole_places[:0]
            if not len(mine) and not len(full):
                continue
            mark[:] = False
            mark[full] = True
            longest = size if len(full) else 0
            # Sizes fall, and where the whole content is, it is what survives: the first word beside it counts.
            for k in mine.tolist():
                if sizes[k] <= longest:
                    break
                if not mark[places[start[row[k]] : end[row[k]]]].all():
                    longest = int(sizes[k])
            for r in row[mine].tolist():
                mark[places[start[r] : end[r]]] = True
            out.append((seq, int(np.count_nonzero(mark)), longest))
    seq, n, longest = zip(*out, strict=True) if out else ((), (), ())
    return pa.table([pa.array(seq, pa.int64()), pa.array(n, pa.int64()), pa.array(longest, pa.int64())], ["del_seq", "n", "longest"])


def _whole_places(whole: DataFrame, index: Index, few: DataFrame, many: DataFrame, found: DataFrame) -> DataFrame:
    """del_seq of a distinct content, block and places of the survivors that have it as a substring."""
    words = few.join(found, ["space", "probe"]).select("word", "del_seq").unionByName(many.select("word", "del_seq")).distinct()
    near = index.postings.join(words, "word").select("del_seq", "block", F.explode("at").alias("place")).select("del_seq", (F.col("block") * BLOCK + F.col("place")).alias("pid")).distinct()
    near = written(near, "residue-near")
    sure = near.join(whole, "del_seq").join(index.texts, "pid").where(F.contains("survivor", "deleted"))
    block, place = F.call_function("shiftright", F.col("pid"), F.lit(_BITS)), F.col("pid").bitwiseAND(F.lit(BLOCK - 1))
    return sure.groupBy("del_seq", block.alias("block")).agg(F.collect_list(place.cast("smallint")).alias("at"))


def verbatim(deletes: DataFrame, survivors: DataFrame) -> DataFrame:
    """del_seq, n and longest: the survivors of each delete in the verbatim tier, copies included, and the bytes of the longest fragment.

    deletes: del_seq, content; survivors: content. The same as counting residue.matches(verbatim=True); deletes without a
    match have no row. A null content matches nothing and is no survivor.
    """
    gone = deletes.select(F.col("del_seq").cast("long").alias("del_seq"), trimmed(F.col("content")).alias("deleted")).where("deleted != ''")
    gone = written(gone.withColumn("strong", F.array_distinct(F.filter(R.distinctive(F.col("deleted")), R.strong))), "residue-deletes")
    chunks = max(1, -(-gone.count() // CHUNK))
    texts = written(survivors.where("content IS NOT NULL").select(F.monotonically_increasing_id().alias("pid"), F.col("content").alias("survivor")), "residue-texts")
    postings = written(texts.mapInArrow(block_words, "word string, block long, at array<smallint>"), "residue-blocks")
    vocabulary = written(postings.groupBy("word").agg(F.sum(F.size("at").cast("long")).alias("df")).select(F.lit(RAW).alias("space"), "word", "df"), "residue-vocabulary")
    index = Index(texts, postings, vocabulary)
    # Equal contents are looked up once, under the least of their numbers.
    whole = written(gone.groupBy("deleted").agg(F.min("del_seq").alias("del_seq")), "residue-wholes")
    few, many = residue_index.whole_traces(whole, index, RAW, pieces(F.col("deleted")))
    words = gone.select(F.explode("strong").alias("probe")).distinct()
    found = written(residue_index.substring_words(index, words.select(F.lit(RAW).alias("space"), "probe").union(few.select("space", "probe"))), "residue-found")
    names = words.join(found.select("probe").distinct(), "probe", "left_semi").withColumn("id", F.monotonically_increasing_id())
    names = written(names, "residue-names")
    each = gone.select("del_seq", F.explode("strong").alias("probe")).join(names, "probe")
    ordered = F.sort_array(F.collect_list(F.struct((-F.octet_length("probe")).alias("size"), "id"))).alias("_words")
    listed = each.groupBy("del_seq").agg(ordered)
    asked = gone.select("del_seq", "deleted").join(whole.withColumnRenamed("del_seq", "whole"), "deleted").join(listed, "del_seq", "left")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    asked = asked.select(
        "del_seq",
        F.pmod(F.xxhash64("del_seq"), F.lit(chunks)).alias("chunk"),
        F.octet_length("deleted").cast("long").alias("size"),
        "whole",
        F.coalesce(F.col("_words")["id"], none("long")).alias("ids"),
        F.coalesce(F.transform(F.col("_words")["size"], lambda n: (-n).cast("long")), none("long")).alias("sizes"),
    )
    asked = written(asked, "residue-asked")
    lists = postings.join(found.join(names, "probe").select("word", "id"), "word").join(asked.select(F.explode("ids").alias("id"), "chunk").distinct(), "id")
    lists = lists.select("block", "chunk", "id", "at", F.lit(False).alias("whole"))
    wholes = _whole_places(whole, index, few, many, found).join(asked.select(F.col("whole").alias("del_seq"), "chunk").distinct(), "del_seq")
    lists = lists.unionByName(wholes.select("block", "chunk", F.col("del_seq").alias("id"), "at", F.lit(True).alias("whole")))
    every = asked.join(written(postings.select("block").distinct(), "residue-block-numbers"))
    every = every.withColumnsRenamed({"block": "in_block", "chunk": "in_chunk"})
    counted = lists.groupBy("block", "chunk").cogroup(every.groupBy("in_block", "in_chunk")).applyInArrow(_counted, "del_seq long, n long, longest long")
    return counted.groupBy("del_seq").agg(F.sum("n").alias("n"), F.max("longest").alias("longest"))
