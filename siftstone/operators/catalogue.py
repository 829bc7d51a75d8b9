"""Catalogue: listings, what a scan changed, what is pending, orphans, batches of work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from . import mime

# fixed values: extensions whose files are read as text, by an office reader, and by a reader that gives a title too
TEXT = (
    "txt", "text", "md", "markdown", "rst", "org", "log", "csv", "tsv", "tex", "bib", "json", "jsonl", "ndjson",
    "yaml", "yml", "toml", "ini", "conf", "cfg", "properties", "env", "desktop",
    "html", "htm", "xhtml", "xml", "svg", "css", "scss", "sass", "srt", "vtt",
    "rs", "py", "vala", "c", "h", "cpp", "cc", "cxx", "hpp", "js", "mjs", "cjs", "ts", "tsx", "jsx", "sh", "bash", "zsh", "fish",
    "go", "java", "kt", "kts", "rb", "php", "pl", "pm", "lua", "sql", "swift", "dart", "hs", "ml", "r", "jl", "nim", "zig",
)
OFFICE = ("docx", "odt", "ods", "odp", "pptx", "xlsx")
TITLED = ("epub", "eml", "rtf", "doc")


def filters(under: str | None = None, ext: Sequence[str] | None = None, mime: Sequence[str] | None = None, mtime: tuple[int, int] | None = None, size: tuple[int, int] | None = None, kind: str | None = None) -> Column:
    """The filter of a request over files(path, mime, mtime, size). An ext list without a usable entry matches nothing."""
    out = F.lit(True)
    if under is not None:
        out &= paths.under(F.col("path"), under)
    if ext is not None:
        usable = [e.lstrip(".").lower() for e in ext]
        usable = [e for e in usable if e and "." not in e and "/" not in e]
        out &= F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*usable) if usable else F.lit(False)
    if mime is not None:
        whole = [m for m in mime if not m.endswith("/*")]
        major = [m[:-2] for m in mime if m.endswith("/*")]
        hit = F.lit(False)
        if whole:
            hit |= F.col("mime").isin(*whole)
        if major:
            hit |= F.split_part("mime", F.lit("/"), F.lit(1)).isin(*major)
        out &= hit
    for column, between in (("mtime", mtime), ("size", size)):
        if between is not None:
            out &= F.col(column).between(*between)
    if kind is not None:
        out &= (F.col("mime") == "inode/directory") if kind == "folder" else (F.col("mime") != "inode/directory")
    return out


def listing(files: DataFrame, order: str = "mtime", where: Column | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of files by mtime or size, largest first, then path."""
    kept = files if where is None else files.where(where)
    return kept.orderBy(F.desc(order), "path").offset(offset).limit(limit)


def list_paths(files: DataFrame, under: str, limit: int) -> DataFrame:
    """Distinct paths below a folder, and the folder itself, in order."""
    return files.where(paths.under(F.col("path"), under) | (F.col("path") == under)).select("path").distinct().orderBy("path").limit(limit)


def children(files: DataFrame, folder: str) -> DataFrame:
    """Entries one level below: files, and folders that only show in longer paths."""
    base = folder.rstrip("/") + "/"
    rest = F.substring("path", len(base) + 1, 1 << 20)
    below = files.where(paths.under(F.col("path"), folder)).withColumn("rest", rest)
    first = F.substring_index("rest", "/", 1)
    return below.groupBy(F.concat(F.lit(base), first).alias("path")).agg(F.max(F.instr("rest", "/") > 0).alias("is_folder"))


def scan_changes(seen: DataFrame, known: DataFrame) -> DataFrame:
    """(path, change): new, changed, gone or unchanged, by a full outer join of a scan and the catalogue."""
    s = seen.select("path", F.struct("mtime", "size").alias("s"))
    k = known.select("path", F.struct("mtime", "size").alias("k"))
    change = F.when(F.col("k").isNull(), "new").when(F.col("s").isNull(), "gone").when(F.col("s") != F.col("k"), "changed").otherwise("unchanged")
    return s.join(k, "path", "full_outer").select("path", change.alias("change"))


def subtree_changes(seen: DataFrame, known: DataFrame, root: str) -> DataFrame:
    """scan_changes() of one folder and all below it; what lies elsewhere is neither read nor gone."""
    inside = (F.col("path") == root) | paths.under(F.col("path"), root)
    return scan_changes(seen.where(inside), known.where(inside))


def unseen(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Catalogue rows that the scan did not meet."""
    return known.join(seen.select("path"), "path", "left_anti")


def stale(names: DataFrame, content: DataFrame) -> DataFrame:
    """Rows of names whose content is missing or of another mtime or size: work that is pending."""
    c = content.select("path", F.col("mtime").alias("m2"), F.col("size").alias("s2"))
    return names.join(c, "path", "left").where(F.col("m2").isNull() | (F.col("m2") != F.col("mtime")) | (F.col("s2") != F.col("size"))).drop("m2", "s2")


def page_after(rows: DataFrame, after: str, limit: int) -> DataFrame:
    """Keyset page: the limit rows that follow a path."""
    return rows.where(F.col("path") > after).orderBy("path").limit(limit)


def below(rows: DataFrame, roots: DataFrame, itself: bool) -> DataFrame:
    """(path) of rows(path) that lie below a root(root), or, with itself, are one.

    A path meets roots by equality with its own ancestors: a shuffle that any number of roots goes through.
    """
    up = paths.ancestors(F.col("path"))
    up = F.concat(up, F.array("path")) if itself else up
    met = rows.select("path", F.explode(up).alias("root"))
    return met.join(roots.select("root"), "root", "left_semi").select("path").distinct()


def retain_prefixes(known: DataFrame, seen: DataFrame, prefixes: DataFrame) -> DataFrame:
    """seen, and what the catalogue has below the prefixes(prefix) of sources that are offline; seen rows win."""
    kept = known.join(below(known, prefixes.withColumnRenamed("prefix", "root"), False), "path", "left_semi")
    return seen.unionByName(kept.join(seen.select("path"), "path", "left_anti").select(*seen.columns))


def remove_trees(known: DataFrame, roots: DataFrame) -> DataFrame:
    """known without the roots(root) and all below them; siblings that share a beginning stay."""
    return known.join(below(known, roots, True), "path", "left_anti")


def move_trees(known: DataFrame, moves: DataFrame) -> DataFrame:
    """known(path, ...) with what lies at or below moves(root, to) under its new name; what lay there before is gone.

    The deepest moved folder above a path takes it along. moves names each root once.
    """
    up = known.select("path", F.explode(F.concat(paths.ancestors(F.col("path")), F.array("path"))).alias("root"))
    taken = up.join(moves.select("root", "to"), "root").groupBy("path").agg(F.max_by(F.struct("root", "to"), F.length("root")).alias("m"))
    new = F.concat(F.col("m.to"), F.substring(F.col("path"), F.length("m.root") + 1, F.lit(1 << 20)))
    moved = known.join(taken, "path").withColumn("path", new).drop("m")
    rest = remove_trees(known.join(taken.select("path"), "path", "left_anti"), moves.select(F.col("to").alias("root")))
    return rest.unionByName(moved.select(*rest.columns))


def apply_changes(known: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """Tree removals first, then sets(path, mtime, size) replace or add."""
    rest = remove_trees(known, roots).join(sets.select("path"), "path", "left_anti")
    return rest.select("path", "mtime", "size").unionByName(sets.select("path", "mtime", "size"))


def divergence(index: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(docs, cached, state): inflated, deflated (repairable or not) or fine."""
    n = index.agg(F.count(F.lit(1)).alias("docs")).crossJoin(catalogue.agg(F.count(F.lit(1)).alias("cached")))
    docs, cached = F.col("docs"), F.col("cached")
    inflated = (docs > cached + F.greatest(F.floor(cached / 5), F.lit(10_000))) | ((docs > 0) & (cached == 0))
    repairable = cached - docs <= F.greatest(F.floor(cached / 100), F.lit(1000))
    return n.withColumn("state", F.when(inflated, "inflated").when((cached > docs) & repairable, "repairable").when(cached > docs, "deflated").otherwise("fine"))


def batch_fill(pending: DataFrame, limit: int, budget: int, now: int, cooldown: int = 900, cap: int = 4 << 20) -> DataFrame:
    """The next batch of pending files: the cheapest first, by count and bytes; files edited within cooldown wait.

    The first file always fits; the first that doesn't ends the batch. Only limit files are ever ranked.
    """
    age = F.lit(now) - F.col("mtime")
    ready = pending.where(~((age >= 0) & (age < cooldown))).withColumn("cost", read_cost(F.col("ext"), F.col("size"), cap))
    top = ready.orderBy("cost", "path").limit(limit)
    order = Window.orderBy("cost", "path")
    ranked = top.withColumns({"rn": F.row_number().over(order), "sum": F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return ranked.where((F.col("rn") == 1) | (F.col("sum") <= budget)).select("path", "cost", "rn")


def soonest_retry(pending: DataFrame, now: int, cooldown: int = 900) -> DataFrame:
    """(seconds): the least time until a file that waits may be read, one at least."""
    age = F.lit(now) - F.col("mtime")
    return pending.where((age >= 0) & (age < cooldown)).agg(F.greatest(F.min(F.lit(cooldown) - age), F.lit(1)).cast("bigint").alias("seconds"))


def owners(files: DataFrame, sources: DataFrame) -> DataFrame:
    """files with the source(prefix, source) of the longest matching path prefix; null where none owns it.

    A path is joined by equality to its own ancestors, each at its depth, so no pair of path and source is tried.
    """
    up = files.select("path", F.explode(paths.ancestors(F.col("path"))).alias("prefix"))
    best = up.join(sources, "prefix").groupBy("path").agg(F.max_by("source", F.length("prefix")).alias("owner"))
    return files.join(best, "path", "left")


def prune_roots(roots: DataFrame) -> DataFrame:
    """roots(root) without those that lie below another."""
    up = roots.select("root", F.explode(paths.ancestors(F.col("root"))).alias("above"))
    nested = up.join(roots.select(F.col("root").alias("above")), "above", "left_semi").select("root").distinct()
    return roots.join(nested, "root", "left_anti")


def duplicates(files: DataFrame, named: int = 64, salts: int = 32) -> DataFrame:
    """(identity, representative, duplicates, n): files of one physical identity, read once; 64 duplicates are named.

    The first paths of an identity are found among shares of its files, so that no task orders all that share one.
    """
    g = files.groupBy("identity").agg(F.min("path").alias("representative"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = files.select("identity", "path", F.pmod(F.xxhash64("path"), F.lit(salts)).alias("share"))
    for by in (["identity", "share"], ["identity"]):
        order = Window.partitionBy(*by).orderBy("path")
        rows = rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= named + 1)
    first = rows.where("rn > 1").groupBy("identity").agg(F.array_sort(F.collect_list("path")).alias("duplicates"))
    return g.join(first, "identity")


def count(rows: DataFrame, where: Column | None = None) -> DataFrame:
    """(n): all rows that the filter takes, uncapped."""
    return (rows if where is None else rows.where(where)).agg(F.count(F.lit(1)).alias("n"))


def length(known: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """(n): how many paths the catalogue has with changes that aren't written yet: trees go, then sets are added."""
    kept = remove_trees(known, roots).select("path").union(sets.select("path")).distinct()
    return count(kept)


# sources and policies


def policies(files: DataFrame, sources: DataFrame, names_only: bool = False) -> DataFrame:
    """files with content and metadata: whether the owner of sources(prefix, content, metadata) has them read.

    Files without an owner are read; names_only turns both off whatever the owner says.
    """
    if names_only:
        return files.withColumns({"content": F.lit(False), "metadata": F.lit(False)})
    said = sources.select("prefix", F.struct("content", "metadata").alias("source"))
    own = owners(files.select("path"), said).select("path", "owner")
    yes = F.lit(True)
    return files.join(own, "path", "left").withColumns({"content": F.coalesce("owner.content", yes), "metadata": F.coalesce("owner.metadata", yes)}).drop("owner")


def offline_retained(sources: DataFrame) -> DataFrame:
    """(prefix) of sources(prefix, kind, available) whose files stay in the catalogue while they are away."""
    return sources.where(F.col("kind").isin("removable", "network") & ~F.col("available")).select("prefix")


def unique_sources(sources: DataFrame) -> DataFrame:
    """sources(prefix, uuid, label, name, rank) with id and source, each prefix once, the longest first for lookups.

    Of sources with one prefix the first by rank counts. id: the uuid, else the path; the name is the configured one,
    else the label, else the last part of the path.
    """
    first = F.min_by(F.struct("uuid", "label", "name"), "rank").alias("s")
    base = F.substring_index("prefix", "/", -1)
    one = sources.groupBy("prefix").agg(first)
    return one.select("prefix", F.coalesce("s.uuid", "prefix").alias("id"), F.coalesce(*(F.when(c != "", c) for c in (F.col("s.name"), F.col("s.label"), base)), F.lit("/")).alias("source"))


def mounts(lines: DataFrame) -> DataFrame:
    """(prefix, device, fstype, rank) of the mount table's lines(n, line); octal escapes are decoded, rank is the order.

    A line: id parent major:minor root mountpoint options [fields] - fstype device ...
    """
    # once a backslash's three digits are read, what they stand for is one character
    escapes = {"040": " ", "011": "\t", "012": "\n", "134": "\\"}
    part = F.split("line", " ")
    tail = F.split(F.element_at(F.split("line", " - "), -1), " ")

    def plain(c: Column) -> Column:
        pieces = F.regexp_extract_all(c, F.lit(r"\\[0-7]{3}|[^\\]+|\\"), F.lit(0))
        known = F.create_map(*[F.lit(x) for k, v in escapes.items() for x in (f"\\{k}", v)])
        return F.array_join(F.transform(pieces, lambda x: F.coalesce(F.element_at(known, x), x)), "")

    rows = lines.where(F.size(part) >= 7)
    return rows.select(plain(part[4]).alias("prefix"), plain(tail[1]).alias("device"), tail[0].alias("fstype"), F.col("n").alias("rank"))


def mount_of(files: DataFrame, mounted: DataFrame) -> DataFrame:
    """files with the device of the deepest mount above them; of mounts at one place the last is on top."""
    top = mounted.groupBy("prefix").agg(F.max_by(F.struct("device", "fstype"), "rank").alias("source"))
    up = files.select("path", F.explode(F.concat(paths.ancestors(F.col("path")), F.array("path"))).alias("prefix"))
    root = top.where("prefix = '/'").select(F.col("source").alias("root"))
    best = up.join(top, "prefix").groupBy("path").agg(F.max_by("source", F.length("prefix")).alias("mount"))
    out = files.join(best, "path", "left").join(F.broadcast(root), F.lit(True), "left")  # at most one row has the prefix /
    return out.withColumn("mount", F.coalesce("mount", "root")).drop("root")


def repo_ignored(files: DataFrame, trees: DataFrame, rules: DataFrame) -> DataFrame:
    """(path) of files that git ignores: below a work tree of trees(root), by rules(folder, n, rule) of .gitignore files.

    The nearest folder with an opinion decides, in it the last rule that fits; a rule fits the path itself or one of the
    folders above it. Rules of folders outside the work tree say nothing.
    """
    up = files.select("path", F.explode(paths.ancestors(F.col("path"))).alias("folder"))
    tree = up.join(trees.select(F.col("root").alias("folder")), "folder").groupBy("path").agg(F.max("folder").alias("tree"))
    asked = up.join(tree, "path").where(F.length("folder") >= F.length("tree"))
    body = F.regexp_replace(F.regexp_replace(F.col("rule"), "^!", ""), "/$", "")
    anchored = F.regexp_replace(body, "^/", "").contains("/") | body.startswith("/")
    glob = F.regexp_replace(F.regexp_replace(body, "^/", ""), r"([.+^$(){}|\\])", r"\\$1")
    for old, new in ((r"\*\*/", "\u0001"), (r"\*\*", "\u0002"), (r"\*", "[^/]*"), (r"\?", "[^/]"), ("\u0001", "(?:.*/)?"), ("\u0002", ".*")):
        glob = F.regexp_replace(glob, old, new)
    pattern = F.concat(F.when(anchored, "^").otherwise("^(?:.*/)?"), glob, F.when(F.col("rule").endswith("/"), "/").otherwise("(?:/|$)"))
    said = rules.where((F.trim("rule") != "") & ~F.col("rule").startswith("#")).select("folder", "n", pattern.alias("pattern"), F.col("rule").startswith("!").alias("back"))
    inside = F.substring(F.col("path"), F.length("folder") + 2, F.lit(1 << 20))
    fits = asked.join(said, "folder").where(F.regexp_like(inside, F.col("pattern")))
    last = fits.groupBy("path").agg(F.max_by("back", F.struct(F.length("folder").alias("depth"), "n")).alias("back"))
    return last.where(~F.col("back")).select("path")


# content work


def extraction_candidates(files: DataFrame, sniff: bool = True) -> DataFrame:
    """files(path, ext, content, metadata, tagged) with candidate: whether anything in them is to be read.

    Content is read of known extensions; metadata of media, of tagged files and, when sniffing, of those without one.
    """
    text_like = F.col("ext").isin(*TEXT, "pdf", *OFFICE, *TITLED)
    meta = F.col("tagged") | mime.kind_of_ext(F.col("ext")).isNotNull() | (F.lit(sniff) & (F.col("ext") == ""))
    return files.withColumn("candidate", (F.col("content") & text_like) | (F.col("metadata") & meta))


def settle(pending: DataFrame, now: int, cooldown: int = 900) -> DataFrame:
    """pending(path, mtime, candidate, gone, folder) with what becomes of each: skip, defer or read.

    What isn't wanted, is gone or is a folder gets a mark, so that it isn't listed again; files changed within the
    cooldown wait; a time in the future doesn't.
    """
    age = F.lit(now) - F.col("mtime")
    return pending.withColumn("state", F.when(~F.col("candidate") | F.col("gone") | F.col("folder"), "skip").when((age >= 0) & (age < cooldown), "defer").otherwise("read"))


def record_skipped(state: DataFrame, settled: DataFrame) -> DataFrame:
    """state(path, mtime, size) with the skipped files of settled as they stand: pending work leaves them out then."""
    new = settled.where("state = 'skip'").select("path", "mtime", "size")
    return state.join(new.select("path"), "path", "left_anti").unionByName(new)


def forget(state: DataFrame, gone: DataFrame) -> DataFrame:
    """state without the paths of gone(path)."""
    return state.join(gone.select("path"), "path", "left_anti")


def next_batch(pending: DataFrame, after: str | None, limit: int, budget: int, now: int, cooldown: int = 900) -> DataFrame:
    """(path, cost, rn): the next batch of a pass that goes on after a path, in the order of paths.

    pending(path, mtime, size, ext). Files within the cooldown are passed over. The first file always fits, the first
    that doesn't ends the batch.
    """
    rows = pending if after is None else pending.where(F.col("path") > after)
    age = F.lit(now) - F.col("mtime")
    rows = rows.where(~((age >= 0) & (age < cooldown))).withColumn("cost", read_cost(F.col("ext"), F.col("size")))
    top = rows.orderBy("path").limit(limit)
    order = Window.orderBy("path")  # over limit rows at most
    ranked = top.withColumns({"rn": F.row_number().over(order), "sum": F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    over = ranked.withColumn("over", F.min(F.when((F.col("rn") > 1) & (F.col("sum") > budget), F.col("rn"))).over(Window.partitionBy()))
    return over.where(F.col("over").isNull() | (F.col("rn") < F.col("over"))).select("path", "cost", "rn")


def read_cost(ext: Column, size: Column, cap: int = 4 << 20) -> Column:
    """Bytes that reading a file takes: of text no more than the cap."""
    return F.when(ext.isin(*TEXT, "pdf"), F.least(size, F.lit(cap))).otherwise(size).cast("bigint")


def free_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """wanted(folder, stem, ext, order) with name: stem.ext, or with (2), (3) ... up to (999) if that is taken.

    taken(folder, name). Those that want one name get theirs by order; a number is free if nothing in the folder has it.
    """
    named = lambda k: F.concat("stem", F.when(k > 1, F.concat(F.lit(" ("), k.cast("string"), F.lit(")"))).otherwise(""), F.when(F.col("ext") != "", F.concat(F.lit("."), "ext")).otherwise(""))
    groups = wanted.groupBy("folder", "stem", "ext").agg(F.count(F.lit(1)).alias("n"))
    # of the names that a group may take as many are tried as it has members and the folder has names of its form
    base = F.regexp_extract("name", r"(?s)^(.*?)(?: \((\d{1,3})\))?(?:\.([^.]*))?$", 1)
    held = taken.groupBy("folder", base.alias("stem")).agg(F.count(F.lit(1)).alias("held"))
    tried = groups.join(held, ["folder", "stem"], "left").withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.lit(999), (F.col("n") + F.coalesce("held", F.lit(0)) + 1).cast("int")))))
    free = tried.withColumn("name", named(F.col("k"))).join(taken.select("folder", "name"), ["folder", "name"], "left_anti")
    by = ["folder", "stem", "ext"]
    free = free.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("k"))).select(*by, "place", "name")
    return wanted.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("order"))).join(free, [*by, "place"], "left").drop("place")


def shared_identity(files: DataFrame, limit: int = 1024) -> DataFrame:
    """files(path, dev, ino, size, links, extents) with identity: what tells that two paths are one content on the disk.

    Hard links are one by device, number and size. Otherwise all extents(start, length, physical, shared) must be
    physical and shared, and at most limit of them; files that have none are no one's copies. Equal texts are not.
    """
    linked = F.col("links") > 1
    good = F.size("extents").between(1, limit) & F.forall("extents", lambda e: e["physical"] & e["shared"])
    listed = F.sha2(F.concat_ws(",", F.transform("extents", lambda e: F.concat_ws("+", e["start"].cast("string"), e["length"].cast("string")))), 256)
    by_extents = F.concat_ws(":", F.lit("e"), F.col("dev").cast("string"), F.col("size").cast("string"), listed)
    by_number = F.concat_ws(":", F.lit("i"), F.col("dev").cast("string"), F.col("ino").cast("string"), F.col("size").cast("string"))
    return files.withColumn("identity", F.when(linked, by_number).when(good, by_extents))


def recovery(states: DataFrame) -> DataFrame:
    """divergence() with what is done about it: nothing, repair (missing names are added) or rebuild."""
    return states.withColumn("action", F.when(F.col("state") == "fine", "nothing").when(F.col("state") == "repairable", "repair").otherwise("rebuild"))
