"""Records of unequal origin: required keys, fields under several names, the last of several versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evidentia.functions import text as X

#: The names under which records carry a field, the first that is filled counts.
ALIASES = {
    "text": ("text", "content", "chunk", "passage"),
    "group": ("doc_id", "source_path", "path", "source", "file", "document_id"),
    "index": ("chunk_idx", "chunk_index", "idx", "i", "position"),
    "section": ("section_id", "section", "heading", "header_path", "title_path"),
    "uid": ("chunk_id", "id", "uid"),
}
UNKNOWN = "UNKNOWN_DOC"


def required(rows: DataFrame, *keys: str) -> DataFrame:
    """rows as they are; a null or empty key fails the job and names the column."""
    for key in keys:
        missing = F.col(key).isNull() | (F.col(key).cast("string") == "")
        rows = rows.withColumn(key, F.when(missing, F.raise_error(F.lit(f"missing {key}"))).otherwise(F.col(key)))
    return rows


def _paths(schema: StructType, names: tuple[str, ...], inner: tuple[str, ...]) -> list[Column]:
    """The columns of these names, those of the rows first, then those within their structs `inner`."""
    found = [F.col(f"`{n}`") for n in names if n in schema.fieldNames()]
    for struct in inner:
        if struct in schema.fieldNames() and isinstance(schema[struct].dataType, StructType):
            found += [F.col(f"`{struct}`.`{n}`") for n in names if n in schema[struct].dataType.fieldNames()]
    return found


def aliased(rows: DataFrame, inner: tuple[str, ...] = ("meta", "metadata")) -> DataFrame:
    """(uid, group, index, section, text) of records that name these fields in different ways.

    A blank value counts as missing. A missing group is UNKNOWN, a missing text
    empty, a missing index or section null; a missing uid is made of the group and
    the index, or of the group and the text's MD5. Indexes that aren't whole
    numbers are missing. Columns that no alias names are ignored.
    """
    filled = lambda c: F.when(~X.is_blank(c.cast("string")), X.strip(c.cast("string")))
    first = lambda field: F.coalesce(*map(filled, _paths(rows.schema, ALIASES[field], inner)), F.lit(None).cast("string"))
    texts = F.coalesce(*[c.cast("string") for c in _paths(rows.schema, ALIASES["text"], inner)], F.lit(""))
    number = first("index")
    index = F.when(number.rlike("^[0-9]+$"), number.try_cast("int"))
    named = rows.select(first("uid").alias("uid"), F.coalesce(first("group"), F.lit(UNKNOWN)).alias("group"), index.alias("index"), first("section").alias("section"), texts.alias("text"))
    made = F.concat(F.col("group"), F.lit("::#"), F.coalesce(F.col("index").cast("string"), F.md5("text")))
    return named.withColumn("uid", F.coalesce("uid", made))


def last_wins(rows: DataFrame, key: str, order: list[str], unique: str) -> DataFrame:
    """The last row of each key by `order` (nulls first), then by `unique`, a column without repeats; rows with a null key are left out.

    Only keys and order are grouped; whole rows aren't sorted or aggregated.
    """
    place = F.struct(*order, unique)
    last = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(place).alias("_last")).select(F.col(f"_last.{unique}").alias(unique))
    return rows.join(last, unique, "left_semi")
