"""Names and paths as Column expressions: safety, clean-up, natural order, planned outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Device names that no file may bear, and characters that no name may have.
RESERVED = ["CON", "PRN", "AUX", "NUL", *[f"COM{i}" for i in range(1, 10)], *[f"LPT{i}" for i in range(1, 10)]]
ILLEGAL = r'[<>:"/\\|?*\x00-\x1f]'


def stem(name: Column) -> Column:
    """The last path segment without its suffix; a leading dot starts no suffix."""
    return F.regexp_replace(base_name(name), r"(?<=.)\.[^.]*$", "")


def suffix(name: Column) -> Column:
    """The suffix with its dot, lower case; '' where there is none."""
    return F.lower(F.regexp_extract(base_name(name), r".(\.[^.]+)$", 1))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def is_reserved(name: Column) -> Column:
    return F.upper(F.substring_index(name, ".", 1)).isin(RESERVED)


def is_unsafe_name(name: Column) -> Column:
    """Empty, reserved, with an illegal or control character, or with a dot or blank at its end."""
    return (name == "") | is_reserved(name) | name.rlike(ILLEGAL) | name.rlike(r"[. ]$")


def safe_name(name: Column) -> Column:
    """A name that is safe: bad characters become '_', ends are trimmed, reserved names get a '_' before them."""
    clean = F.regexp_replace(F.trim(F.regexp_replace(name, ILLEGAL, "_")), r"[. ]+$", "")
    clean = F.when(clean == "", "_").otherwise(clean)
    return F.when(is_reserved(clean), F.concat(F.lit("_"), clean)).otherwise(clean)


def safe_relative_path(path: Column) -> Column:
    """The path with each part made safe; null where it is absolute, has a drive, a home or a parent in it, or no part."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(slashed, "/"), lambda p: (p != "") & (p != "."))
    bad = slashed.rlike(r"^(/|~|[A-Za-z]:)") | F.exists(parts, lambda p: p == "..") | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(F.transform(parts, safe_name), "/"))


def sanitize_title(title: Column, most: int = 200) -> Column:
    """A title fit for a file name: forbidden characters become '_', white space single blanks, ends are trimmed."""
    clean = F.regexp_replace(F.regexp_replace(title, ILLEGAL, "_"), r"\s+", " ")
    clean = F.regexp_replace(clean, r"^[ .]+|[ .]+$", "")
    return F.substring(F.when(clean == "", "untitled").otherwise(clean), 1, most)


def extensions(text: Column) -> Column:
    """'PNG, .jpg txt' as a sorted array of distinct lower-case suffixes."""
    parts = F.filter(F.split(F.lower(text), r"[,\s]+"), lambda p: p != "")
    return F.array_sort(F.array_distinct(F.transform(parts, lambda p: F.when(p.startswith("."), p).otherwise(F.concat(F.lit("."), p)))))


def natural_key(name: Column) -> Column:
    """A string that sorts as the name with its numbers compared by value, however long: before the digits of each number
    stands how many they are."""
    runs = F.regexp_extract_all(name, F.lit(r"([0-9]+|[^0-9]+)"), 1)
    digits = lambda r: F.regexp_replace(r, "^0+(?=.)", "")
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits(r)).cast("string"), 10, "0"), digits(r))).otherwise(r)), "")


def planned_output(path: Column, root: Column, out: Column, kind: str, ending: Column) -> Column:
    """Where a result goes. mirror: below `out` as it lies below `root`; flat: in `out`; sibling: in a folder of that name
    beside the source."""
    name = F.concat(stem(path), ending)
    below = F.substring(folder(path), F.length(root) + 1, 1 << 20)
    if kind == "mirror":
        return F.when(path.startswith(F.concat(root, F.lit("/"))), F.concat(out, below, F.lit("/"), name)).otherwise(F.concat(out, F.lit("/"), name))
    if kind == "flat":
        return F.concat(out, F.lit("/"), name)
    return F.concat(folder(path), F.lit("/"), out, F.lit("/"), name)


def is_within(root: Column, target: Column) -> Column:
    return (target == root) | target.startswith(F.concat(root, F.lit("/")))


def numbered(name_stem: Column, n: Column, ending: Column) -> Column:
    """The n-th of equal names: the first as it is, then stem_001, stem_002 and so on."""
    return F.when(n == 0, F.concat(name_stem, ending)).otherwise(F.format_string("%s_%03d%s", name_stem, n, ending))


def replace_text(text: Column, find: str, by: str, regex: bool = False) -> Column:
    """Literal or pattern replacement; an empty `find` changes nothing. Groups are written \\1 as in Python."""
    if find == "":
        return text
    if not regex:
        return F.replace(text, F.lit(find), F.lit(by))
    import re

    return F.regexp_replace(text, f"(?U){find}", re.sub(r"\\(\d)", r"$\1", by.replace("$", r"\$")))


def count_matches(text: Column, find: str, regex: bool = False) -> Column:
    if find == "":
        return F.lit(0).cast("int")
    if regex:
        return F.regexp_count(text, F.lit(f"(?U){find}"))
    return ((F.length(text) - F.length(F.replace(text, F.lit(find), F.lit("")))) / len(find)).cast("int")
