"""Moving a corpus of format 0.2 to 0.3: instance arrows become objects, and what names them follows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import saved

#: Where a tree names others, as lists and as single ids.
LISTS = ("depends", "about", "fields", "assumes", "data", "acts_on", "generalized_by")
SINGLE = ("proves", "hom", "instance_of", "type", "same_as", "from", "to", "inverse")
TARGET = r"(?<=\[\[)[^\[\]|#]++"


def resolved(renames: DataFrame) -> DataFrame:
    """``old, new``: each rename followed to the end of its chain, by jumps that double.

    ``renames(old, new)`` with distinct old names; a name renamed to itself or
    null is none.  Names that go round in a circle are an error.
    """
    now = saved(renames.where("old is not null and new is not null and old != new").select("old", "new"))
    left = now.count()
    for _ in range(max(1, left.bit_length() + 1)):
        longer = now.join(now.select(F.col("old").alias("new"), F.col("new").alias("next")), "new", "left")
        if not (more := longer.where("next is not null").count()):
            return now
        now = saved(longer.select("old", F.coalesce("next", "new").alias("new")))
    raise ValueError(f"{more} names are renamed in a circle")


def rewritten_links(bodies: DataFrame, ends: DataFrame) -> DataFrame:
    """``id, body`` with the targets of links renamed by ``ends(old, new)``; labels, fragments and all else stay."""
    rows = bodies.select("id", "body", F.regexp_extract_all("body", F.lit(TARGET), F.lit(0)).alias("targets"))
    each = rows.select("id", F.posexplode("targets").alias("pos", "target")).withColumn("old", F.trim("target")).join(ends, "old", "left")
    puts = each.groupBy("id").agg(F.count("new").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("new", "target").alias("put")))), lambda x: x["put"]).alias("puts"))
    pieces = F.zip_with(F.split("body", TARGET, -1), "puts", lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return rows.join(puts.where("n > 0"), "id", "left").select("id", F.when(F.col("puts").isNull(), F.col("body")).otherwise(F.array_join(pieces, "")).alias("body"))


def migrated(trees: DataFrame) -> DataFrame:
    """The trees of a 0.2 corpus as 0.3 asks for them, with the columns they have.

    ``type`` of an object becomes ``instance_of``.  An arrow of kind instance
    becomes the object ``obj-X`` for ``mor-X`` (``obj-X-instance`` where that
    id is taken): its symbol is the arrow's statement, it is an instance of
    what the arrow went to, and kind, ends, needs and label go.  Lists, single
    ids and links that name it name the object.  Other trees keep their ids;
    ids are distinct.
    """
    here = trees.columns
    arrows = trees.where("taxon = 'morphism' and kind = 'instance'").select(F.col("id").alias("old"), F.concat(F.lit("obj-"), F.regexp_replace("id", "^mor-", "")).alias("new"))
    taken = trees.select(F.col("id").alias("new"), F.lit(True).alias("taken"))
    ends = resolved(arrows.join(taken, "new", "left").select("old", F.when(F.col("taken"), F.concat("new", F.lit("-instance"))).otherwise(F.col("new")).alias("new")))
    turned = F.coalesce((F.col("taxon") == "morphism") & (F.col("kind") == "instance"), F.lit(False))
    thing = F.coalesce(F.col("taxon") == "object", F.lit(False))
    new = {"taxon": F.when(turned, "object").otherwise(F.col("taxon"))}
    if "symbol" in here:
        new["symbol"] = F.when(turned, F.col("statement")).otherwise(F.col("symbol"))
    if "instance_of" in here:
        new["instance_of"] = F.when(turned, F.col("to")).when(thing, F.coalesce("instance_of", "type")).otherwise(F.col("instance_of"))
    for c in ("kind", "from", "to", "needs", "label", "statement", "type"):
        if c in here:
            new[c] = F.when(turned | (thing if c == "type" else F.lit(False)), F.lit(None)).otherwise(F.col(c))
    rows = trees.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in here])

    lists, single = [c for c in LISTS if c in here], [c for c in SINGLE if c in here]
    refs = F.concat(F.array().cast("array<struct<field:string,pos:int,old:string>>"), *[F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), _placed(c)) for c in lists], *[F.array(F.struct(F.lit(c).alias("field"), F.lit(0).alias("pos"), F.col(c).alias("old"))) for c in single])
    each = rows.select("id", F.explode(refs).alias("r")).select("id", "r.*").where("old is not null").join(ends, "old", "left").withColumn("put", F.coalesce("new", "old"))
    told = each.groupBy("id").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == c, F.struct("pos", "put")))), lambda x: x["put"]).alias(f"_l_{c}") for c in lists], *[F.max(F.when(F.col("field") == c, F.col("put"))).alias(f"_s_{c}") for c in single])
    out = rows.join(told, "id", "left")
    if "body" in here:
        out = out.drop("body").join(rewritten_links(rows.select("id", "body"), ends), "id", "left")
    out = out.join(ends.select(F.col("old").alias("id"), F.col("new").alias("_id")), "id", "left")
    value = {c: F.when(F.col(c).isNotNull(), F.col(f"_l_{c}")) for c in lists} | {c: F.col(f"_s_{c}") for c in single}
    value["id"] = F.coalesce("_id", "id")
    value |= {c: F.when(F.col("_id").isNotNull(), F.concat("_id", F.lit(end))).otherwise(F.col(c)) for c, end in (("stem", ""), ("file", ".md")) if c in here}
    return out.select(*[value[c].alias(c) if c in value else F.col(f"`{c}`") for c in here])


def _placed(field: str):
    """References of a list with their places."""

    def of(x, i):
        return F.struct(F.lit(field).alias("field"), i.alias("pos"), x.alias("old"))

    return of
