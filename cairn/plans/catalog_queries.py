"""Queries over merges and the folder tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import catalog
from cairn.registry import query, table

_NEW = "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_name || '!' END AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 10 < 3 UNION ALL SELECT 9000001, 'new', 5.0"


def _upsert(name: str, skip: bool, sql: str):
    @query(name, sql)
    def run(spark, sf_dir):
        old = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
        old.createOrReplaceTempView("customer_now")
        new = spark.sql(_NEW.replace("FROM customer", "FROM customer_now"))
        return catalog.upsert(old, new, ["c_custkey"], keep=("c_acctbal",), skip_nulls=skip)

    return run


_upsert("K6_upsert", False, f"WITH n AS ({_NEW}) SELECT coalesce(a.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NOT NULL THEN n.c_name ELSE a.c_name END AS c_name, CASE WHEN a.c_custkey IS NULL THEN n.c_acctbal ELSE a.c_acctbal END AS c_acctbal FROM customer a FULL JOIN n ON a.c_custkey = n.c_custkey")
_upsert("K8_upsert_skip_nulls", True, f"WITH n AS ({_NEW}) SELECT coalesce(a.c_custkey, n.c_custkey) AS c_custkey, coalesce(n.c_name, a.c_name) AS c_name, CASE WHEN a.c_custkey IS NULL THEN n.c_acctbal ELSE a.c_acctbal END AS c_acctbal FROM customer a FULL JOIN n ON a.c_custkey = n.c_custkey")


@query("K7_bulk_update", "SELECT s_suppkey, s_name || CASE WHEN s_suppkey % 2 = 0 THEN '*' ELSE '' END AS s_name, CASE WHEN s_suppkey % 2 = 0 THEN 7 ELSE s_nationkey END AS s_nationkey FROM supplier")
def bulk_update(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    changes = rows.filter("s_suppkey % 2 = 0").select("s_suppkey", F.concat("s_name", F.lit("*")).alias("s_name"))
    return catalog.update(rows, changes, "s_suppkey", s_nationkey=7)


@query("K10_soft_delete", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 1 WHEN o_orderkey % 5 = 0 THEN 2 ELSE 0 END AS deleted FROM orders")
def soft_delete(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 5 == 0, 2).otherwise(0).alias("deleted"))
    return catalog.soft_delete(rows, table(spark, sf_dir, "customer").filter("c_acctbal < 0").select("c_custkey"), "o_custkey").select("o_orderkey", "deleted")


@query("K11_drop_documents", "SELECT vec_id FROM embeddings WHERE label NOT IN (1, 2)")
def drop_documents(spark, sf_dir):
    ids = spark.sql("SELECT explode(array(1, 2)) AS label")
    return catalog.drop_documents(table(spark, sf_dir, "embeddings"), ids, "label").select("vec_id")


@query("K14_purge_report", "SELECT 'orders' AS table_name, count(*) FILTER (WHERE o_orderkey % 5 = 0) AS trashed, count(*) AS total FROM orders UNION ALL SELECT 'part', count(*) FILTER (WHERE p_size < 5), count(*) FROM part")
def purge_report(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("deleted", F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0))
    parts = table(spark, sf_dir, "part").withColumn("deleted", F.when(F.col("p_size") < 5, 1).otherwise(0))
    return catalog.purge_report({"orders": orders, "part": parts})


#: Folders by id, parent, name, path, depth.
FOLDERS = "VALUES (1, NULL, 'docs', '/docs', 0, 0), (2, 1, 'web', '/docs/web', 1, 0), (3, 2, 'a_b%', '/docs/web/a_b%', 2, 0), (4, 1, 'back', '/docs/back', 1, 1), (5, NULL, 'docs2', '/docs2', 0, 0), (6, 5, 'x', '/docs2/x', 1, 0)"
_NAMES = "(folder_id, parent_folder_id, folder_name, full_path, depth, deleted)"


def _folders(spark):
    return spark.sql(f"SELECT * FROM {FOLDERS} AS t{_NAMES}")


@query("W1_delete_subtree", f"SELECT folder_id, CASE WHEN deleted <> 0 THEN deleted WHEN folder_id = 1 THEN 1 WHEN starts_with(full_path, '/docs/') THEN 2 ELSE deleted END AS deleted FROM ({FOLDERS}) t{_NAMES}")
def delete_subtree(spark, sf_dir):
    return catalog.delete_subtree(_folders(spark), 1).select("folder_id", "deleted")


@query("W6_move_subtree", f"SELECT folder_id, CASE WHEN starts_with(full_path, '/docs/web') THEN '/docs2/web' || substr(full_path, 10) ELSE full_path END AS full_path, depth, CASE WHEN folder_id = 2 THEN 5 ELSE parent_folder_id END AS parent_folder_id FROM ({FOLDERS}) t{_NAMES}")
def move_subtree(spark, sf_dir):
    return catalog.move_subtree(_folders(spark), 2, 5).select("folder_id", "full_path", "depth", "parent_folder_id")


@query("W2_restore_subtree", f"SELECT folder_id, 0 AS deleted FROM ({FOLDERS}) t{_NAMES}")
def restore_subtree(spark, sf_dir):
    return catalog.restore_subtree(catalog.restore_subtree(catalog.delete_subtree(_folders(spark), 1), 1), 4).select("folder_id", "deleted")


@query("W10_file_counts", "SELECT o_orderpriority AS folder, count(*) AS files FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1")
def file_counts(spark, sf_dir):
    own = spark.sql("SELECT explode(array('1-URGENT', '5-LOW')) AS folder_id")
    return catalog.files_in(table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "folder_id"), own).groupBy(F.col("folder_id").alias("folder")).agg(F.count(F.lit(1)).alias("files"))


@query("W14_shared_documents", "SELECT l_partkey AS document_id, count(*) AS files FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1 HAVING count(*) > 1")
def shared_documents(spark, sf_dir):
    files = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("document_id"), F.when(F.col("l_returnflag") == "N", 0).otherwise(1).alias("deleted"))
    return catalog.shared_documents(files)
