"""Writes as merges over tables, and the folder tree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LIVE, TRASHED, CASCADED = 0, 1, 2


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key."""
    rn = F.row_number().over(Window.partitionBy(*key).orderBy(*(F.desc(o) for o in order)))
    return rows.withColumn("__rn", rn).filter("__rn = 1").drop("__rn")


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], keep: Sequence[str] = ("creator",), skip_nulls: bool = False) -> DataFrame:
    """K6, K8, K9: new rows are added, columns of known ones replaced but for ``keep``; nulls too, unless skip_nulls."""
    a, b = old.alias("a"), new.withColumn("__new", F.lit(True)).alias("b")
    met = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key], "full_outer")
    hit = F.col("b.__new").isNotNull()
    existed = F.col(f"a.{key[0]}").isNotNull()

    def value(c: str):
        if c in key:
            return F.coalesce(f"a.{c}", f"b.{c}")
        if c not in new.columns:
            return F.col(f"a.{c}")
        if c in keep:
            return F.when(existed, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))
        return F.coalesce(f"b.{c}", f"a.{c}") if skip_nulls else F.when(hit, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))

    return met.select(*(value(c).alias(c) for c in old.columns))


def update(old: DataFrame, changes: DataFrame, key: str, **constants) -> DataFrame:
    """K7: known keys only; what a change leaves null stays."""
    cols = [c for c in changes.columns if c != key]
    met = old.join(changes.select(key, *(F.col(c).alias(f"__{c}") for c in cols), F.lit(True).alias("__hit")), key, "left")
    out = met
    for c in cols:
        out = out.withColumn(c, F.coalesce(f"__{c}", c))
    for c, v in constants.items():
        out = out.withColumn(c, F.when(F.col("__hit"), F.lit(v)).otherwise(F.col(c)))
    return out.select(*old.columns)


def soft_delete(rows: DataFrame, ids: DataFrame, key: str, mark: int = TRASHED) -> DataFrame:
    """Live rows among the ids get the mark."""
    gone = ids.select(F.col(ids.columns[0]).alias(key)).distinct().withColumn("__gone", F.lit(True))
    met = rows.join(gone, key, "left")
    return met.withColumn("deleted", F.when(F.col("__gone") & (F.col("deleted") == LIVE), F.lit(mark)).otherwise(F.col("deleted"))).select(*rows.columns)


def drop_documents(vectors: DataFrame, ids: DataFrame, key: str = "document_id") -> DataFrame:
    """Vectors of deleted documents are removed."""
    return vectors.join(ids.select(key).distinct(), key, "left_anti")


def purge_report(tables: dict[str, DataFrame]) -> DataFrame:
    """How many rows of each table are in the trash."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.lit(name).alias("table_name"), F.count_if(F.col("deleted") == TRASHED).alias("trashed"), F.count(F.lit(1)).alias("total"))
        out = part if out is None else out.unionByName(part)
    return out


def delete_subtree(folders: DataFrame, folder_id) -> DataFrame:
    """The folder is trashed, live folders below it are marked as cascaded."""
    root = folders.filter(F.col("folder_id") == folder_id).select(F.col("full_path").alias("__root"))
    met = folders.crossJoin(F.broadcast(root))  # one row
    mark = F.when(F.col("folder_id") == folder_id, TRASHED).when(F.col("full_path").startswith(F.concat("__root", F.lit("/"))), CASCADED)
    return met.withColumn("deleted", F.when((F.col("deleted") == LIVE) & mark.isNotNull(), mark).otherwise(F.col("deleted"))).drop("__root")


def move_subtree(folders: DataFrame, folder_id, target_id) -> DataFrame:
    """The folder goes below the target (None: the top), paths and depths of all below follow.

    Raises if the target lies in the folder, or holds a live folder of that name.
    """
    own = folders.filter(F.col("folder_id") == folder_id).first()
    if own is None:
        raise ValueError("no such folder")
    to = folders.filter(F.col("folder_id") == target_id).first() if target_id is not None else None
    if target_id is not None and (to is None or to["full_path"] == own["full_path"] or to["full_path"].startswith(own["full_path"] + "/")):
        raise ValueError("a folder can't move into itself or nowhere")
    here = F.col("parent_folder_id").isNull() if target_id is None else F.col("parent_folder_id") == target_id
    if not folders.filter(here & (F.col("folder_name") == own["folder_name"]) & (F.col("folder_id") != folder_id) & (F.col("deleted") == LIVE)).isEmpty():
        raise ValueError("the name is taken there")
    new = (to["full_path"] if to else "") + "/" + own["folder_name"]
    shift = (to["depth"] + 1 if to else 0) - own["depth"]
    inside = (F.col("folder_id") == folder_id) | F.col("full_path").startswith(own["full_path"] + "/")
    path = F.concat(F.lit(new), F.substring("full_path", len(own["full_path"]) + 1, 1 << 20))
    return folders.withColumns({"full_path": F.when(inside, path).otherwise(F.col("full_path")), "depth": F.when(inside, F.col("depth") + shift).otherwise(F.col("depth")), "parent_folder_id": F.when(F.col("folder_id") == folder_id, F.lit(target_id)).otherwise(F.col("parent_folder_id"))})


def restore_subtree(folders: DataFrame, folder_id) -> DataFrame:
    """The folder and what was deleted with it are live again; without a live parent it goes to the top."""
    own = folders.filter(F.col("folder_id") == folder_id).first()
    inside = (F.col("folder_id") == folder_id) | (F.col("full_path").startswith(own["full_path"] + "/") & (F.col("deleted") == CASCADED))
    out = folders.withColumn("deleted", F.when(inside, LIVE).otherwise(F.col("deleted")))
    parent = own["parent_folder_id"]
    if parent is not None and folders.filter((F.col("folder_id") == parent) & (F.col("deleted") == LIVE)).isEmpty():
        out = move_subtree(out, folder_id, None)
    return out


def hard_delete(folders: DataFrame, folder_id=None) -> DataFrame:
    """A subtree, or all that is in the trash."""
    if folder_id is None:
        return folders.filter(F.col("deleted") == LIVE)
    own = folders.filter(F.col("folder_id") == folder_id).first()
    return folders.filter(~((F.col("folder_id") == folder_id) | F.col("full_path").startswith(own["full_path"] + "/")))


def trash(rows: DataFrame, order: str = "update_time", key: str = "folder_id") -> DataFrame:
    """W7."""
    return rows.filter(F.col("deleted") == TRASHED).orderBy(F.desc(order), key)


def files_in(files: DataFrame, folders: DataFrame) -> DataFrame:
    """W8."""
    return files.join(folders.select("folder_id").distinct(), "folder_id", "left_semi")


def get_or_create(rows: DataFrame, wanted: DataFrame, key: Sequence[str]) -> DataFrame:
    """Wanted rows whose key is not taken yet are added."""
    return rows.unionByName(wanted.join(rows, list(key), "left_anti"), allowMissingColumns=True)


def shared_documents(files: DataFrame) -> DataFrame:
    """Documents that several live files share."""
    return files.filter(F.col("deleted") == LIVE).groupBy("document_id").agg(F.count(F.lit(1)).alias("files")).filter("files > 1")


def content_ids(rows: DataFrame, content: str, key: str) -> DataFrame:
    """Equal content has the id of its first row."""
    first = rows.groupBy(F.sha2(F.col(content).cast("binary"), 256).alias("sha256")).agg(F.min(key).alias("document_id"), F.count(F.lit(1)).alias("copies"))
    return rows.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256)).join(first, "sha256")


def cascade_files(files: DataFrame, folders: DataFrame, action: str) -> DataFrame:
    """The files of a set of folders are trashed with them (live ones only), restored (cascaded ones only) or dropped (trashed ones)."""
    hit = files.join(folders.select("folder_id").distinct().withColumn("__in", F.lit(True)), "folder_id", "left")
    inside = F.coalesce("__in", F.lit(False))
    if action == "purge":
        return hit.filter(~(inside & (F.col("deleted") != LIVE))).select(*files.columns)
    was, to = {"delete": (LIVE, CASCADED), "restore": (CASCADED, LIVE)}[action]
    return hit.withColumn("deleted", F.when(inside & (F.col("deleted") == was), F.lit(to)).otherwise(F.col("deleted"))).select(*files.columns)


def move_files(files: DataFrame, moves: DataFrame, folders: DataFrame) -> DataFrame:
    """(file_id, folder_id, outcome) of each wanted move (file_id, target_id).

    The target must exist, be live and belong to the file's user and knowledge base; a file that is there already is
    skipped. Outcomes: moved, same, no_file, no_folder.
    """
    target = folders.filter(F.col("deleted") == LIVE).select(F.col("folder_id").alias("target_id"), F.col("user_id").alias("__user"), F.col("knowledge_base_id").alias("__kb"))
    met = moves.join(files.filter(F.col("deleted") == LIVE).select("file_id", F.col("folder_id").alias("__was"), "user_id", "knowledge_base_id", F.lit(True).alias("__file")), "file_id", "left").join(target, "target_id", "left")
    fits = (F.col("__user") == F.col("user_id")) & (F.col("__kb") == F.col("knowledge_base_id"))
    outcome = F.when(F.col("__file").isNull(), "no_file").when(~F.coalesce(fits, F.lit(False)), "no_folder").when(F.col("__was") == F.col("target_id"), "same").otherwise("moved")
    return met.select("file_id", F.when(outcome == "moved", F.col("target_id")).otherwise(F.col("__was")).alias("folder_id"), outcome.alias("outcome"))


def touched_sessions(sessions: DataFrame, messages: DataFrame, key: str = "session_id") -> DataFrame:
    """Q14: counters grow by the new messages, and the time of the last one is set; other sessions stay."""
    more = messages.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.max("at").alias("__at"))
    met = sessions.join(more, key, "left")
    return met.withColumn("message_count", F.col("message_count") + F.coalesce("__n", F.lit(0))).withColumn("last_message_at", F.greatest("last_message_at", "__at")).select(*sessions.columns)


def rows_by_ids(rows: DataFrame, ids: DataFrame, key: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Q2, Q8: the live rows of some ids, in the order of the key; a page of them if one is wanted."""
    out = rows.filter(F.col("deleted") == LIVE).join(ids.select(key).distinct(), key, "left_semi").orderBy(key)
    return out.offset(offset) if limit is None else out.offset(offset).limit(limit)
