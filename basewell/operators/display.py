"""Ranges as text."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from . import index as ix
from . import ranges, words


#: What stands where a value has no flank.
NO_FLANK, NO_FLANK_LONG = ".. ", ".............. "


def shown(index: DataFrame) -> DataFrame:
    """key, text, detail: a line per value in (ref_id, pos) order; flanks as 16 bases, or dots where there are none. For capped indexes: a key's lines share a row."""
    flank = F.when(F.col("flank").isNotNull(), dna.decode("flank", 16))
    packed = F.concat(F.coalesce(F.concat(flank, F.lit(": ")), F.lit(NO_FLANK)), dna.pack("ref_id", "pos").cast("string"))
    detail = F.concat(F.coalesce(flank, F.lit(NO_FLANK_LONG)), F.lit(": "), F.col("ref_id").cast("string"), F.lit(" "), F.col("pos").cast("string"))
    lines = index.select("key", "ref_id", "pos", packed.alias("packed"), detail.alias("detail"))
    ordered = lines.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ref_id", "pos", "packed", "detail"))).alias("v"))
    return ordered.select("key", F.array_join(F.transform("v", lambda x: x["packed"]), "\n").alias("text"), F.array_join(F.transform("v", lambda x: x["detail"]), "\n").alias("detail"))


def _texts(r: ranges.Range, a: int, z: int, *names: str) -> list[pa.Array]:
    return [pc.cast(r.array(c, a, z), pa.string()) for c in names]


def shown_pages(index: DataFrame, every: DataFrame, page: int = ix.PAGE, least: int | None = None) -> DataFrame:
    """The lines of `shown` in rows (key, page) of at most `page`, for keys of any number of values. every: the keys' counts; flanks of keys of at most `least` values aren't shown."""

    def columns(r: ranges.Range, a: int, z: int) -> dict[str, pa.Array]:
        ref, pos = _texts(r, a, z, "ref_id", "pos")
        flank = r.columns["flank"]
        word, none = words.strings(words.decoded(flank.values[a:z], 16)), None if flank.missing is None else pa.array(flank.missing[a:z])
        where = r.columns["ref_id"].values[a:z] % (1 << dna.VALUE_BITS) << dna.POSITION_BITS | r.columns["pos"].values[a:z] % (1 << dna.POSITION_BITS)
        packed = pc.cast(pa.array(where, mask=None if r.columns["ref_id"].missing is None else r.columns["ref_id"].missing[a:z]), pa.string())
        short, long = pc.binary_join_element_wise(word, "", ": "), word
        if none is not None:
            short, long = pc.if_else(none, NO_FLANK, short), pc.if_else(none, NO_FLANK_LONG, long)
        return {"text": pc.binary_join_element_wise(short, packed, ""), "detail": pc.binary_join_element_wise(pc.binary_join_element_wise(long, ref, ": "), pos, " ")}

    return ranges.paged(index, every, page, columns, {"text": "\n", "detail": "\n"}, least=least).drop("n")


def listed_pages(index: DataFrame, every: DataFrame, page: int = ix.PAGE, least: int | None = None) -> DataFrame:
    """key, n, page, listed: ref_id:pos:flank of a page's values, with commas between; nothing stands for a flank that is not kept."""

    def columns(r: ranges.Range, a: int, z: int) -> dict[str, pa.Array]:
        ref, pos, flank = _texts(r, a, z, "ref_id", "pos", "flank")
        return {"listed": pc.binary_join_element_wise(ref, pos, pc.fill_null(flank, ""), ":")}

    return ranges.paged(index, every, page, columns, {"listed": ","}, least=least)
