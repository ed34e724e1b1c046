"""Listings of folders as tables: project scans, texture sets, packages of assets with their side files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import textures
from .tables import rank_within

#: Fixed value: the identifier in a side file.
GUID = r"(?m)^guid:\s*([0-9a-fA-F]{32})\s*$"


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def stem_of(path: Column) -> Column:
    return F.regexp_replace(name_of(path), r"(?<=.)\.[^.]*$", "")


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(name_of(path), r".(\.[^.]*)$", 1))


def ignored(name: Column) -> Column:
    """Hidden names, backups and temporary files."""
    return name.startswith(".") | name.endswith("~") | F.lower(name).endswith(".tmp")


def below(path: Column, folders: list[str]) -> Column:
    out = F.lit(False)
    for f in folders:
        out = out | path.startswith(f.rstrip("/") + "/")
    return out


def find_projects(files: DataFrame, root: str, suffix: str, recursive: bool = True, exclude: list[str] = ()) -> DataFrame:
    """Files (path) of a suffix below root, but not below excluded folders; flat: only right in root. Callers that want the
    files in order sort them; a scan has no limit here."""
    suffix = suffix.lower() if suffix.startswith(".") else "." + suffix.lower()
    found = files.where(below(F.col("path"), [root]) & (suffix_of(F.col("path")) == suffix) & ~below(F.col("path"), list(exclude)))
    return found if recursive else found.where(folder_of(F.col("path")) == root.rstrip("/"))


def visible_folders(folders: DataFrame, root: str, redo: str | None = None) -> DataFrame:
    """Folders (path) that a set scan visits (fixed values): no part below root begins with '.' or '_' or ends in .ksmat, and none lies in
    the redo folder."""
    rest = F.substring(F.col("path"), len(root.rstrip("/")) + 1, 1 << 20)
    hidden = rest.rlike(r"/[._]") | F.lower(rest).rlike(r"\.ksmat(/|$)")
    kept = folders.where((F.col("path") == root.rstrip("/")) | (below(F.col("path"), [root]) & ~hidden))
    return kept if redo is None else kept.where((F.col("path") != redo.rstrip("/")) & ~below(F.col("path"), [redo]))


def texture_sets(files: DataFrame) -> DataFrame:
    """(folder, name, base_map): the sets that base maps name in each folder. The map of the best base token stands for its
    set, the first by path of equal ones; a bare token takes the folder's name."""
    named = files.select("path", folder_of(F.col("path")).alias("folder"), textures.base_split(stem_of(F.col("path"))).alias("name"))
    named = named.where("name IS NOT NULL").withColumn("name", F.when(F.col("name") == "", name_of(F.col("folder"))).otherwise(F.col("name")))
    named = named.withColumn("clean", F.lower(textures.split_resolution(stem_of(F.col("path")))[0]))
    ends = F.transform(F.array(*map(F.lit, textures.BASE_TOKENS)), lambda t, i: F.when(F.endswith("clean", t), i))
    rank = F.array_min(ends)
    best = named.groupBy("folder", "name").agg(F.min(F.struct(rank.alias("rank"), "path")).alias("top"))
    return best.select("folder", "name", F.col("top.path").alias("base_map"))


def scan(sets: DataFrame, decisions: DataFrame) -> DataFrame:
    """sets with their decision (key, decision), 'pending' where there is none."""
    return sets.join(decisions.withColumnRenamed("key", "base_map"), "base_map", "left").withColumn("decision", F.coalesce("decision", F.lit("pending")))


def guid_of(meta: Column) -> Column:
    """The identifier in the first 4,096 bytes of a side file, in lower case; null without one."""
    found = F.regexp_extract(F.substring(meta, 1, 4096), GUID, 1)
    return F.when(found != "", F.lower(found))


def package_entries(assets: DataFrame, metas: DataFrame, includes: list[str], root: str = "Assets") -> DataFrame:
    """(pathname, guid, is_file, bytes, reason): what a package of the included paths and the folders above them holds.

    assets: path, is_file, bytes; metas: path (of the asset), meta. Entries without a side file or without an identifier in
    it have a reason instead; of one identifier under several paths each is a 'duplicate guid'.
    """
    inside, above = F.lit(False), F.lit(False)
    for include in includes:
        inside = inside | (F.col("path") == include) | F.col("path").startswith(include + "/")
        above = above | (~F.col("is_file") & F.lit(include).startswith(F.concat("path", F.lit("/"))))
    parts = F.split(F.col("path"), "/")
    clean = ~F.exists(parts, lambda p: ignored(p)) & ~F.col("path").endswith(".meta")
    wanted = assets.where((inside | above) & clean & (F.col("path") != root) & F.col("path").startswith(root + "/"))
    both = wanted.join(metas.select("path", "meta"), "path", "left").withColumn("guid", guid_of(F.col("meta")))
    owners = both.where("guid IS NOT NULL").groupBy("guid").agg(F.count_distinct("path").alias("owners"))
    reason = F.when(F.col("meta").isNull(), "no side file").when(F.col("guid").isNull(), "no readable guid").when(F.col("owners") > 1, "duplicate guid")
    return both.join(owners, "guid", "left").select(F.col("path").alias("pathname"), "guid", "is_file", F.when(F.col("is_file"), F.col("bytes")).alias("bytes"), reason.alias("reason"))


def unpack_entries(members: DataFrame) -> DataFrame:
    """(archive, pathname, asset): from members (archive, ord, name, content) of packages, the asset of each identifier under
    its path name; of repeated members the first counts, entries that lack either are folders and left out."""
    name = F.regexp_replace("name", r"^\./", "")
    parts = members.select("archive", "ord", F.regexp_extract(name, r"([^/]+)/[^/]+$", 1).alias("guid"), F.regexp_extract(name, r"[^/]*$", 0).alias("leaf"), "content")
    first = parts.where("leaf IN ('pathname', 'asset') AND guid != ''").groupBy("archive", "guid", "leaf").agg(F.min_by("content", "ord").alias("content"))
    sides = [first.where(F.col("leaf") == leaf).select("archive", "guid", F.col("content").alias(leaf)) for leaf in ("pathname", "asset")]
    path = F.trim(F.regexp_extract(F.decode(F.substring("pathname", 1, 8192), "UTF-8"), r"^[^\r\n]*", 0))
    return sides[0].join(sides[1], ["archive", "guid"]).select("archive", path.alias("pathname"), "asset").where("pathname != ''")


def free_names(wanted: DataFrame, taken: DataFrame, before: str = "_", after: str = "", first: int = 2) -> DataFrame:
    """(id, name): for each wanted (id, stem, suffix) its name where no taken one (name) equals it, else the first free one of
    stem + before + n + after + suffix, n from `first` on.

    Taken names are cut into stem, number and suffix and joined by equality; the first gap in the numbers is free. A stem may
    have any number of taken names.
    """
    escape = lambda x: "".join("\\" + c if not c.isalnum() and c != " " else c for c in x)
    pattern = rf"^(.*?){escape(before)}([1-9][0-9]{{0,8}}){escape(after)}((?:\.[^.]*)?)$"
    numbers = taken.select(F.regexp_extract("name", pattern, 1).alias("stem"), F.regexp_extract("name", pattern, 3).alias("suffix"), F.regexp_extract("name", pattern, 2).alias("n")).where("n != ''")
    numbers = numbers.select("stem", "suffix", F.col("n").cast("long").alias("n")).where(F.col("n") >= first).distinct()
    ranked = rank_within(numbers, ["stem", "suffix"], ["n"])
    gap = F.when(F.col("n") != F.col("rank") + first, F.col("rank") + first)  # before the first of these a number is free
    used = ranked.groupBy("stem", "suffix").agg(F.coalesce(F.min(gap), F.max("size") + first).alias("free"))
    plain = taken.select(F.col("name").alias("plain")).distinct()
    both = wanted.join(plain, F.concat("stem", "suffix") == F.col("plain"), "left").join(used, ["stem", "suffix"], "left")
    number = F.coalesce("free", F.lit(first))
    name = F.when(F.col("plain").isNull(), F.concat("stem", "suffix")).otherwise(F.concat(F.col("stem"), F.lit(before), number.cast("string"), F.lit(after), F.col("suffix")))
    return both.select("id", name.alias("name"))
