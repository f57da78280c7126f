"""Paths of projects, seen from Windows, its Linux subsystem or Unix, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wharfline.functions.text import let, like, trim_all

DRIVE = r"^[A-Za-z]:/"
MOUNT = r"^/mnt/[a-z](/|$)"


def canonical(path: Column) -> Column:
    """One spelling: forward slashes, none doubled (but two before a share), a capital drive, nothing at the end; '' is null.
    What has no separator and is no drive is returned trimmed."""

    def plain(p: Column) -> Column:
        slashed = F.regexp_replace(F.regexp_replace(F.replace(p, F.lit("\\"), F.lit("/")), "^/{3,}", "//"), "(?<=[^/])/{2,}", "/")
        drive = let(slashed, lambda s: F.when(like(s, "^[a-z]:(/|$)"), F.concat(F.upper(F.left(s, F.lit(1))), F.substr(s, F.lit(2)))).otherwise(s))
        return let(drive, lambda d: F.when(like(d, "^[A-Za-z]:/*$"), F.concat(F.left(d, F.lit(2)), F.lit("/"))).when(like(d, "^/+$"), F.lit("/")).otherwise(F.regexp_replace(d, "/+$", "")))

    shaped = lambda p: F.contains(p, F.lit("/")) | F.contains(p, F.lit("\\")) | like(p, "^[A-Za-z]:$")
    return let(trim_all(path), lambda p: F.when(p == "", None).when(~shaped(p), p).otherwise(plain(p)))


def encoded(path: Column) -> Column:
    """The directory name that stands for a path: everything but ASCII letters and digits is a dash."""
    return F.regexp_replace(path, "[^A-Za-z0-9]", "-")


def ignores_case(canonical_path: Column, windows_host: Column) -> Column:
    return like(canonical_path, DRIVE) | (like(canonical_path, MOUNT) & windows_host)


def belongs(dir_name: Column, cwd: Column, windows_host: Column) -> Column:
    """Whether the directory name stands for cwd; drive paths need not agree in case."""
    same = lambda c: (encoded(c) == dir_name) | (ignores_case(c, windows_host) & (F.lower(encoded(c)) == F.lower(dir_name)))
    return F.coalesce(let(canonical(cwd), same), F.lit(False))


def resolved(dir_name: Column, cwd: Column, windows_host: Column) -> Column:
    """cwd in canonical form where it proves itself, else the directory name as it is."""
    return F.when(belongs(dir_name, cwd, windows_host), canonical(cwd)).otherwise(dir_name)


def variants(path: Column) -> Column:
    """The path and, for a Windows drive, its spelling on the other side of the mount."""

    def both(c: Column) -> Column:
        rest, tail = F.substr(c, F.lit(3)), F.substr(c, F.lit(7))
        mounted = F.concat(F.lit("/mnt/"), F.lower(F.left(c, F.lit(1))), F.when(rest == "/", F.lit("")).otherwise(rest))
        native = F.concat(F.upper(F.substring(c, 6, 1)), F.lit(":"), F.when(tail == "", F.lit("/")).otherwise(tail))
        return F.when(like(c, DRIVE), F.array(c, mounted)).when(like(c, MOUNT), F.array(c, native)).when(c.isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))

    return let(canonical(path), both)


def equivalence_key(path: Column, windows_host: Column) -> Column:
    """Equal for spellings of one directory; null for what is no path."""

    def key(c: Column) -> Column:
        tail = F.substr(c, F.lit(7))
        mounted = F.lower(F.concat(F.substring(c, 6, 1), F.lit(":"), F.when(tail == "", F.lit("/")).otherwise(tail)))
        return F.when(~F.contains(c, F.lit("/")), None).when(like(c, MOUNT) & windows_host, mounted).when(like(c, DRIVE), F.lower(c)).otherwise(c)

    return let(canonical(path), key)


def decoded(dir_name: Column) -> Column:
    """A directory name read as a path: every dash a slash, if it begins with one. Dashes of the path itself are lost, so this serves to filter, not to name."""
    return F.when(dir_name.startswith("-"), F.replace(dir_name, F.lit("-"), F.lit("/"))).otherwise(dir_name)


def most_specific(df, path: str):
    """Rows by the length of their path, longest first."""
    return df.orderBy(F.length(path).desc(), path)


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def parent_id(path: Column) -> Column:
    """The directory above the one and only `subagents` directory; null with none or several."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    n = F.size(F.filter(parts, lambda p: p == "subagents"))
    at = F.array_position(parts, "subagents").cast("int")
    return F.when((n == 1) & (at > 1), F.get(parts, at - 2))


def nesting(path: Column) -> Column:
    return F.size(F.split(path, "/subagents/")) - 1


def windows_host(os: Column) -> Column:
    return F.coalesce(os.isin("win32", "wsl"), F.lit(False))


def ancestors(path: str) -> list[str]:
    """The directory and all above it, for the few paths of a request."""
    out, now = [path], path
    while now != "/" and not (len(now) == 3 and now[1:] == ":/"):
        up, slash, _ = now.rpartition("/")
        if not slash:
            break
        up = "/" if up == "" else f"{up}/" if len(up) == 2 and up[1] == ":" else up
        if up == now:
            break
        out.append(up)
        now = up
    return list(dict.fromkeys(out))


def related(path: Column, cwd: str, windows_backed: bool = False) -> Column:
    """Whether a stored path holds cwd or lies under it."""
    fold = F.lower if windows_backed else (lambda c: c)
    here = cwd.lower() if windows_backed else cwd
    return fold(path).isin(*ancestors(here)) | fold(path).startswith(here if here.endswith("/") else f"{here}/")
