"""File types by glob, with their hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def parse_globs(rows: DataFrame) -> DataFrame:
    """rows(line) weight:type:pattern[:flags] -> (weight, mime, kind, pattern): plain suffixes and literals only."""
    part = F.split("line", ":", 4)
    out = rows.where(~F.col("line").startswith("#")).select(part[0].cast("int").alias("weight"), part[1].alias("mime"), part[2].alias("glob"), F.coalesce(F.get(part, F.lit(3)), F.lit("")).alias("flags"))
    plain = F.substring("glob", 2, 1 << 10)
    kind = F.when(F.col("glob").startswith("*.") & ~plain.rlike(r"[*?\[]"), F.when(F.col("flags").contains("cs"), "cased").otherwise("suffix")).when(~F.col("glob").rlike(r"[*?\[]"), "literal")
    pattern = F.when(kind == "literal", F.col("glob")).when(kind == "suffix", F.lower(plain)).otherwise(plain)
    return out.select("weight", "mime", kind.alias("kind"), pattern.alias("pattern")).where("kind is not null and weight is not null")


def candidates(files: DataFrame, globs: DataFrame) -> DataFrame:
    """(path, mime, weight): literal name, else longest cased suffix, else longest suffix in lower case."""
    n = F.col("name")
    dots = F.filter(F.sequence(F.lit(1), F.char_length(n)), lambda i: F.substring(n, i, 1) == ".")
    ends = F.transform(dots, lambda i: F.struct(i.alias("dot"), F.substring(n, i, 1 << 10).alias("end")))
    keys = F.concat(
        F.array(F.struct(F.lit(0).alias("rank"), F.lit(0).alias("dot"), F.lit("literal").alias("kind"), n.alias("pattern"))),
        F.transform(ends, lambda e: F.struct(F.lit(1).alias("rank"), e["dot"].alias("dot"), F.lit("cased").alias("kind"), e["end"].alias("pattern"))),
        F.transform(ends, lambda e: F.struct(F.lit(2).alias("rank"), e["dot"].alias("dot"), F.lit("suffix").alias("kind"), F.lower(e["end"]).alias("pattern"))),
    )
    hit = files.select("path", F.inline(keys)).join(globs, ["kind", "pattern"])
    best = F.min(F.struct("rank", "dot")).over(Window.partitionBy("path"))
    return hit.withColumn("best", best).where((F.col("rank") == F.col("best.rank")) & (F.col("dot") == F.col("best.dot"))).select("path", "mime", "weight")


def by_name(files: DataFrame, globs: DataFrame) -> DataFrame:
    """(path, mime): the heaviest candidate if it is alone, empty files application/x-zerosize, else octets."""
    c = candidates(files, globs).groupBy("path").agg(F.max(F.struct("weight", "mime")).alias("top"), F.collect_list("weight").alias("weights"))
    c = c.select("path", F.when(F.size(F.filter("weights", lambda w: w == F.col("top.weight"))) == 1, F.col("top.mime")).alias("one"))
    out = files.select("path", "size").join(c, "path", "left")
    return out.select("path", F.when(F.col("size") == 0, "application/x-zerosize").otherwise(F.coalesce("one", F.lit("application/octet-stream"))).alias("mime"))


def ancestry(spark: SparkSession, parents: DataFrame, depth: int = 7) -> DataFrame:
    """(mime, ancestor, distance) of parents(mime, parent), up to depth; each pair by its shortest way."""
    step = parents.select("mime", F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))
    found, edge = step, step
    for k in range(2, depth + 1):
        edge = edge.join(parents.select(F.col("mime").alias("ancestor"), "parent"), "ancestor").select("mime", F.col("parent").alias("ancestor"), F.lit(k).alias("distance")).distinct()
        found = found.union(edge)
    return found.groupBy("mime", "ancestor").agg(F.min("distance").alias("distance"))


# fixed values: extensions of media
MEDIA = {
    "video": ("3gp", "asf", "avi", "divx", "f4v", "flv", "m2ts", "m4v", "mkv", "mov", "mp4", "mpeg", "mpg", "mts", "ogv", "ts", "vob", "webm", "wmv"),
    "audio": ("aac", "ac3", "aif", "aiff", "ape", "dts", "flac", "m4a", "mka", "mp3", "oga", "ogg", "opus", "wav", "wma", "wv"),
    "image": ("avif", "bmp", "dib", "exr", "gif", "heic", "heif", "ico", "jpe", "jpeg", "jpg", "pam", "pbm", "pgm", "png", "pnm", "ppm", "qoi", "svg", "tga", "tif", "tiff", "webp"),
}
#: First bytes of common formats, as hexadecimal digits, and where they stand
SIGNATURES = (
    ("application/pdf", 0, "255044462D"),
    ("application/zip", 0, "504B0304"),
    ("application/gzip", 0, "1F8B"),
    ("application/zstd", 0, "28B52FFD"),
    ("application/x-bzip2", 0, "425A68"),
    ("application/x-xz", 0, "FD377A585A00"),
    ("application/x-7z-compressed", 0, "377ABCAF271C"),
    ("application/x-ole-storage", 0, "D0CF11E0A1B11AE1"),
    ("application/rtf", 0, "7B5C727466"),
    ("application/x-executable", 0, "7F454C46"),
    ("application/x-tar", 257, "7573746172"),
    ("application/vnd.sqlite3", 0, "53514C69746520666F726D61742033"),
    ("application/vnd.apache.parquet", 0, "50415231"),
    ("image/png", 0, "89504E470D0A1A0A"),
    ("image/jpeg", 0, "FFD8FF"),
    ("image/gif", 0, "47494638"),
    ("image/webp", 8, "57454250"),
    ("image/bmp", 0, "424D"),
    ("image/tiff", 0, "49492A00"),
    ("video/mp4", 4, "66747970"),
    ("video/x-matroska", 0, "1A45DFA3"),
    ("video/x-msvideo", 8, "41564920"),
    ("audio/flac", 0, "664C6143"),
    ("audio/ogg", 0, "4F676753"),
    ("audio/mpeg", 0, "494433"),
    ("audio/wav", 8, "57415645"),
)
#: Bytes of a file that tell its type
HEAD = 40 << 10


def kind_of_ext(ext: Column) -> Column:
    """audio, video or image by extension, else null."""
    out = F.lit(None).cast("string")
    for kind, exts in MEDIA.items():
        out = F.when(ext.isin(*exts), kind).otherwise(out)
    return out


def kind_of_mime(mime: Column) -> Column:
    major = F.split_part(mime, F.lit("/"), F.lit(1))
    document = (mime == "application/pdf") | (major == "text")
    packed = mime.contains("zip") | mime.contains("tar") | mime.contains("compress")
    return F.when(major.isin("audio", "video", "image"), major).when(document, "document").when(packed, "archive").otherwise("other")


def sniff(content: Column) -> Column:
    """Type that the first bytes of content say; null if they say nothing.

    Text is UTF-8 without a zero byte. A media signature in text is chance; markup in it is what the text is.
    """
    head = F.substring(content, 1, HEAD)
    found = F.lit(None).cast("string")
    for name, at, digits in reversed(SIGNATURES):
        found = F.when(F.hex(F.substring(head, at + 1, len(digits) // 2)) == digits, name).otherwise(found)
    # the head may end within a character, which latin-1 shows without fail
    bytes_ = F.decode(head, "ISO-8859-1")
    whole = F.regexp_replace(bytes_, r"(?s)(?:[\xC2-\xDF]|[\xE0-\xEF][\x80-\xBF]?|[\xF0-\xF4][\x80-\xBF]{0,2})$", "")
    text = F.is_valid_utf8(F.encode(whole, "ISO-8859-1").cast("string")) & ~F.contains(bytes_, F.lit("\u0000"))
    low = F.lower(F.ltrim(F.left(bytes_, F.lit(512))))
    markup = F.when(low.startswith("<!doctype html") | low.startswith("<html"), "text/html").when(low.startswith("<svg"), "image/svg+xml").when(low.startswith("<?xml"), "application/xml")
    media = F.split_part(found, F.lit("/"), F.lit(1)).isin("video", "audio", "image")
    return F.when(text & (found.isNull() | media), F.coalesce(markup, F.lit("text/plain"))).otherwise(found)


def of(files: DataFrame, globs: DataFrame, closure: DataFrame) -> DataFrame:
    """(path, mime) of files(path, name, size, folder, content), by name and, where names leave it open, by content.

    Folders and empty files are what they are. The heaviest glob decides if it is alone. Else, of the candidates, it is
    the one that the content is or that descends from it most closely, by weight if two do, the content's own type if
    none does, and the heaviest if the content says nothing. closure: ancestry(mime, ancestor, distance).
    """
    c = candidates(files.select("path", "name"), globs).groupBy("path").agg(F.collect_set(F.struct("weight", "mime")).alias("all"))
    top = F.array_max("all")
    alone = F.size(F.filter("all", lambda x: x["weight"] == F.array_max("all")["weight"])) == 1
    c = c.select("path", "all", top.alias("top"), alone.alias("alone"))
    out = files.join(c, "path", "left").withColumn("said", F.when(~F.coalesce("alone", F.lit(False)), sniff(F.col("content"))))
    open_ = out.where("not coalesce(alone, false) and said is not null and all is not null").select("path", "said", F.explode("all").alias("x")).select("path", "said", "x.*")
    near = open_.join(closure.select("mime", F.col("ancestor").alias("said"), "distance"), ["mime", "said"], "left")
    near = near.withColumn("distance", F.when(F.col("mime") == F.col("said"), 0).otherwise(F.col("distance"))).where("distance is not null")
    best = near.groupBy("path").agg(F.min(F.struct("distance", (-F.col("weight")).alias("w"), "mime"))["mime"].alias("near"))
    out = out.join(best, "path", "left")
    named = F.when(F.col("alone"), F.col("top.mime")).otherwise(F.coalesce("near", "said", "top.mime", F.lit("application/octet-stream")))
    return out.select("path", F.when(F.col("folder"), "inode/directory").when(F.col("size") == 0, "application/x-zerosize").otherwise(named).alias("mime"))
