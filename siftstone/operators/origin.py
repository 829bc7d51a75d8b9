"""Where files came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import catalogue


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with new(path, kind, confidence, label, updated_at); a web download never replaces another kind."""
    cols = ["kind", "confidence", "label", "updated_at"]
    o = old.select("path", F.struct(*cols).alias("o"))
    n = new.select("path", F.struct(*cols).alias("n"))
    take = F.col("o").isNull() | (F.col("n").isNotNull() & ((F.col("n.kind") != "web_download") | (F.col("o.kind") == "web_download")))
    out = o.join(n, "path", "full_outer").select("path", F.when(take, F.col("n")).otherwise(F.col("o")).alias("r"))
    return out.select("path", *[F.col(f"r.{c}").alias(c) for c in cols])


def attach(hits: DataFrame, origins: DataFrame) -> DataFrame:
    """hits with the origin struct of their path, null where none is recorded."""
    o = origins.groupBy("path").agg(F.max_by(F.struct("kind", "confidence", "label"), "updated_at").alias("origin"))
    return hits.join(o, "path", "left")


def latest_downloads(downloads: DataFrame, files: DataFrame, slack: int = 60) -> DataFrame:
    """Newest completed download of each path(path, domain, finished_at) whose file hasn't changed since.

    The newest is chosen first: a path whose newest download fails the tests has none.
    """
    order = Window.partitionBy("path").orderBy(F.desc("finished_at"))
    first = downloads.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")
    return first.join(files.select("path", "mtime"), "path").where((F.col("mtime") <= F.col("finished_at") + slack) & F.col("domain").isNotNull())


def completed(files: DataFrame, folder: str) -> DataFrame:
    """Files directly in the downloads folder that are no partial downloads."""
    rest = F.substring("path", len(folder.rstrip("/")) + 2, 1 << 20)
    return files.where(F.col("path").startswith(folder.rstrip("/") + "/") & (F.instr(rest, "/") == 0) & ~F.col("path").rlike(r"\.(crdownload|part|download)$"))


# fixed values: what is written about a file of each kind, and how sure that is; 3 is sure
LABELS = {
    "app_created": "Criado por ",
    "removable_copy": "Copiado do pendrive ",
    "network_copy": "Copiado da rede ",
    "local_copy": "Copiado neste computador",
    "moved_or_renamed": "Movido ou renomeado neste computador",
    "derived_file": "Gerado a partir de ",
    "web_download": "Baixado da internet",
}
SURE, LIKELY = 3, 2
RECORD = ("path", "kind", "confidence", "label", "source_app", "source_path", "source_device_id", "source_device_label", "source_domain", "first_seen_at", "updated_at")


def _label(kind: Column, what: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in LABELS.items() for x in (k, v)])
    named = kind.isin("app_created", "removable_copy", "network_copy", "derived_file")
    return F.concat(F.element_at(table, kind), F.when(named, what).otherwise(F.lit("")))


def register(events: DataFrame, sources: DataFrame, now: int) -> DataFrame:
    """RECORD of events(verb, path, src, app, domain, at): what is known of files that were created, copied, derived or downloaded.

    verb: created, copy, derived or download. A copy is of the kind of the source(prefix, kind, id, name) that its
    original lies in: removable, network, else of this computer. at: when a download arrived, else null.
    """
    state = sources.select("prefix", F.struct("kind", "id", "name").alias("source"))
    # an original is looked up as a path of its own
    origins = events.where("src is not null").select(F.col("src").alias("path")).distinct()
    own = catalogue.owners(origins, state).select(F.col("path").alias("src"), "owner")
    rows = events.join(own, "src", "left")
    kind = (
        F.when(F.col("verb") == "created", "app_created")
        .when(F.col("verb") == "derived", "derived_file")
        .when(F.col("verb") == "download", "web_download")
        .when(F.col("owner.kind") == "removable", "removable_copy")
        .when(F.col("owner.kind") == "network", "network_copy")
        .otherwise("local_copy")
    )
    rows = rows.withColumn("kind", kind)
    away = F.col("kind").isin("removable_copy", "network_copy")
    what = F.when(F.col("kind") == "app_created", F.col("app")).when(away, F.col("owner.name")).otherwise(F.substring_index("src", "/", -1))
    stamp = F.lit(now).cast("bigint")
    return rows.select(
        "path", "kind", F.lit(SURE).alias("confidence"), _label(F.col("kind"), F.coalesce(what, F.lit(""))).alias("label"),
        F.when(F.col("verb") != "download", F.col("app")).alias("source_app"), F.when(F.col("verb").isin("copy", "derived"), F.col("src")).alias("source_path"),
        F.when(away, F.col("owner.id")).alias("source_device_id"), F.when(away, F.col("owner.name")).alias("source_device_label"),
        F.when(F.col("verb") == "download", F.col("domain")).alias("source_domain"),
        F.coalesce(F.when(F.col("verb") == "download", F.col("at")), stamp).alias("first_seen_at"), stamp.alias("updated_at"),
    )


def move(origins: DataFrame, moves: DataFrame, now: int) -> DataFrame:
    """origins(RECORD) after moves(src, path, app), each name once: what is known of a file moves with it.

    Of a file that nothing is known of the move itself is kept, as likely. What was known of a file that the move
    overwrote is replaced, unless it would be by a download.
    """
    stamp = F.lit(now).cast("bigint")
    known = moves.join(origins.withColumnRenamed("path", "src"), "src").withColumn("updated_at", stamp).select(*RECORD)
    rest = moves.join(origins.select(F.col("path").alias("src")), "src", "left_anti")
    none = F.lit(None).cast("string")
    kind = F.lit("moved_or_renamed")
    new = rest.select("path", kind.alias("kind"), F.lit(LIKELY).alias("confidence"), _label(kind, F.lit("")).alias("label"), F.col("app").alias("source_app"), F.col("src").alias("source_path"), none.alias("source_device_id"), none.alias("source_device_label"), none.alias("source_domain"), stamp.alias("first_seen_at"), stamp.alias("updated_at"))
    kept = origins.join(moves.select(F.col("src").alias("path")), "path", "left_anti").select(*RECORD)
    both = kept.select("path", F.struct(*RECORD).alias("o")).join(known.union(new).select("path", F.struct(*RECORD).alias("n")), "path", "full_outer")
    take = F.col("o").isNull() | (F.col("n").isNotNull() & ((F.col("n.kind") != "web_download") | (F.col("o.kind") == "web_download")))
    return both.select(F.when(take, F.col("n")).otherwise(F.col("o")).alias("r")).select("r.*")


def lookup(files: DataFrame, origins: DataFrame) -> DataFrame:
    """files(path, dev, ino) with origin: the record of the path, else the newest of the same dev and ino, else null."""
    what = F.struct("kind", "confidence", "label", "first_seen_at")
    by_path = origins.groupBy("path").agg(F.max_by(what, "updated_at").alias("by_path"))
    by_file = origins.where("dev is not null").groupBy("dev", "ino").agg(F.max_by(what, F.struct("updated_at", "path")).alias("by_file"))
    out = files.join(by_path, "path", "left").join(by_file, ["dev", "ino"], "left")
    return out.withColumn("origin", F.coalesce("by_path", "by_file")).drop("by_path", "by_file")


def browser_downloads(downloads: DataFrame, chains: DataFrame, newest: int = 5000) -> DataFrame:
    """(path, domain, finished_at) of downloads(id, path, state, start_time, end_time) that are complete, the newest by id.

    The address is the first of chains(id, chain_index, url), where the browser kept one. Times are microseconds since
    1601; a download is finished at the later of its two.
    """
    first = chains.where("chain_index = 0").select("id", "url")
    rows = downloads.where("state = 1").orderBy(F.desc("id")).limit(newest).join(first, "id", "left")
    return rows.where("path <> ''").select("path", text.domain_from_url(F.col("url")).alias("domain"), text.webkit_to_unix(F.greatest("start_time", "end_time")).alias("finished_at"))


def of_event(events: DataFrame) -> DataFrame:
    """(path) of events(kind, path, path_to) whose origin is worth a look: created files and what a rename leads to."""
    return events.where("kind = 'create' or (kind = 'rename' and path_to is not null)").select(F.when(F.col("kind") == "rename", F.col("path_to")).otherwise(F.col("path")).alias("path")).distinct()


def forget_all(origins: DataFrame) -> DataFrame:
    return origins.limit(0)
