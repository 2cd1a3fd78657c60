"""Content templates: facts of files with equal contents, kept once and expanded for each file.

Files of one content hash share a template: the facts of one of them (the least path). What a
file's facts take from its path (ids, module names, spans' files) is put back for every
instance by joins on the hash, so contents that very many files share are neither gathered
nor repeated in store.

Facts are made by generators, whose rows Spark's estimates don't count, so a table of facts
looks small enough for the driver however many files there are: the joins here are merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def module_of(path: Column) -> Column:
    """A path up to its last dot, parts joined by '::'."""
    return F.replace(F.regexp_replace(path, r"\.[^.]*$", ""), F.lit("/"), F.lit("::"))


def moved_name(name: Column, from_path: Column, to_path: Column) -> Column:
    """A qualified name of one file as another file of the same contents has it: only a leading module name changes."""
    old, new = module_of(from_path), module_of(to_path)
    rest = F.substr(name, F.length(old) + 1)
    return F.when(name == old, new).when(F.startswith(name, F.concat(old, F.lit("."))) | F.startswith(name, F.concat(old, F.lit("::"))), F.concat(new, rest)).otherwise(name)


def entity_id(path: Column, kind: Column, qualified_name: Column) -> Column:
    return F.concat(F.lit("e:"), F.md5(F.concat_ws("\u001f", path, kind, qualified_name).cast("binary")))


def edge_id(head: Column, relation: Column, tail: Column, path: Column, line: Column) -> Column:
    return F.concat(F.lit("x:"), F.md5(F.concat_ws("\u001f", head, relation, tail, path, line.cast("string")).cast("binary")))


def _merged(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never broadcast by an estimate."""
    return df.hint("merge")


def split(files: DataFrame, entities: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(instances, template entities, template edges) of files (path, hash), entities (path, id,
    kind, name, qualified_name, line) and edges (path, head_id, relation, tail_id, line).

    instances (path, hash, canonical): every file with a hash. Templates are the facts of the
    canonical files only, under their hash and with their own ids as local ones. Files with a null
    path or hash are left out; a path that is listed with several hashes is an instance of each.
    """
    known = files.where("path is not null and hash is not null").select("path", "hash").distinct()
    least = known.groupBy("hash").agg(F.min("path").alias("canonical"))
    instances = known.join(_merged(least), "hash").select("path", "hash", "canonical")
    own = least.select("hash", F.col("canonical").alias("path"))
    return instances, entities.join(_merged(own), "path").drop("path"), edges.join(_merged(own), "path").drop("path")


def expand_entities(instances: DataFrame, template_entities: DataFrame) -> DataFrame:
    """(path, id, kind, name, qualified_name, line, local_id): the entities of every instance."""
    made = instances.join(_merged(template_entities.withColumnRenamed("id", "local_id")), "hash")
    made = made.withColumn("qualified_name", moved_name(F.col("qualified_name"), F.col("canonical"), F.col("path")))
    return made.select("path", entity_id(F.col("path"), F.col("kind"), F.col("qualified_name")).alias("id"), "kind", "name", "qualified_name", "line", "local_id")


def expand_edges(instances: DataFrame, template_entities: DataFrame, template_edges: DataFrame) -> DataFrame:
    """(path, id, head_id, relation, tail_id, line): the edges of every instance, between its own
    entities; an edge with an end that the template doesn't have is left out."""
    known = template_entities.select("hash", F.col("id").alias("local_id"), "kind", "qualified_name").distinct()
    ends = lambda name: _merged(known.select("hash", F.col("local_id").alias(f"{name}_id"), F.struct("kind", "qualified_name").alias(name)))
    # ends are found once for a template, and only what they are called is moved to each instance
    linked = template_edges.join(ends("head"), ["hash", "head_id"]).join(ends("tail"), ["hash", "tail_id"]).drop("head_id", "tail_id")
    made = instances.join(_merged(linked), "hash")
    own = lambda end: entity_id(F.col("path"), F.col(f"{end}.kind"), moved_name(F.col(f"{end}.qualified_name"), F.col("canonical"), F.col("path")))
    made = made.select("path", "relation", "line", own("head").alias("head_id"), own("tail").alias("tail_id"))
    return made.select("path", edge_id(F.col("head_id"), F.col("relation"), F.col("tail_id"), F.col("path"), F.col("line")).alias("id"), "head_id", "relation", "tail_id", "line")
