"""Names and labels: anonymised file names, masked addresses in texts, short ids, display names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathloom.functions import paths as P
from pathloom.functions import shapes as S

EMAIL_IN_TEXT = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
#: Words of file names that tell nothing about a person: formats, terms of exports, platforms (fixed values).
KNOWN_WORDS = (
    "zip", "json", "csv",
    "data", "export", "download", "archive", "takeout", "account", "user", "my", "your", "personal", "information", "info", "activity", "request", "backup", "part", "file", "files", "copy", "final", "new",
    "tiktok", "instagram", "facebook", "meta", "youtube", "google", "twitter", "linkedin", "snapchat", "whatsapp", "threads", "reddit", "spotify", "netflix", "amazon", "apple", "pinterest", "discord", "telegram", "bluesky",
)


def anonymous_file_name(name: Column, known: tuple[str, ...] = KNOWN_WORDS) -> Column:
    """The last part of a path with unknown words as x per letter and digits as 0."""
    base = F.regexp_replace(name, r"^.*[/\\]", "")
    runs = F.regexp_extract_all(base, F.lit(r"(\p{L}+|\p{Nd}+|[^\p{L}\p{Nd}]+)"), F.lit(1))
    words = F.array(*map(F.lit, known))
    hidden = lambda r: F.when(F.array_contains(words, F.lower(r)), r).otherwise(F.regexp_replace(F.regexp_replace(r, r"\p{L}", "x"), r"\p{Nd}", "0"))
    return F.array_join(F.transform(runs, hidden), "")


def masked_addresses(text: Column) -> Column:
    """A text with the e-mail addresses in it masked."""
    runs = F.regexp_extract_all(text, F.lit(rf"({EMAIL_IN_TEXT}|(?s).)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(f"^{EMAIL_IN_TEXT}$"), S.mask(r)).otherwise(r)), "")


def short_id(path: Column) -> Column:
    return F.left(F.sha1(path), F.lit(10))


def masked_key(segment: Column, key: Column) -> Column:
    """The name of a renamed key: only what its pattern leaves open is masked."""
    at = F.instr(segment, "{*}")
    head = F.when(at > 0, F.substr(segment, F.lit(1), at - 1)).otherwise("")
    tail = F.when(at > 0, F.substr(segment, at + 3)).otherwise("")
    inner = F.substr(key, F.length(head) + 1, F.length(key) - F.length(head) - F.length(tail))
    fits = (at > 0) & ~F.contains(tail, F.lit("{*}")) & F.startswith(key, head) & F.endswith(key, tail) & (F.length(key) > F.length(head) + F.length(tail))
    return F.when(fits, F.concat(head, S.mask_name(inner), tail)).otherwise(S.mask_name(key))


def display_name(path: Column, name: Column) -> Column:
    return F.when(path == "", "Upload").when(P.last(path) == "[]", "each item").otherwise(F.coalesce(name, P.last(path)))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9_]+", "-"), "^-+|-+$", "")


def format_of(ext: Column, kind: Column) -> Column:
    """The format of an upload's root: its ending without the dot, or else its kind."""
    return F.coalesce(F.nullif(F.lower(F.regexp_replace(F.coalesce(ext, F.lit("")), r"^\.", "")), F.lit("")), kind)


def looks_like(declared: Column, head: Column) -> Column:
    """Whether the first bytes of a file can be of the declared format."""
    text = F.ltrim(F.decode(head, "utf-8"))
    zip_magic = F.substring(F.hex(head), 1, 8).isin("504B0304", "504B0506")
    no_nul = ~F.contains(F.decode(head, "iso-8859-1"), F.lit("\0"))
    first_line = F.substring_index(text, "\n", 1)
    return F.when(declared == "zip", zip_magic).when(declared == "json", no_nul & text.rlike(r"^[\[{]")).when(declared == "csv", no_nul & first_line.rlike("[,;\t|]")).otherwise(no_nul)


def named_like(folder: Column, container: Column) -> Column:
    """Whether a folder is named like its zip: letter by letter, whatever the case and what systems add to a copy's name.

    The zip's name may be masked: its x stands for any letter, its 0 for any digit.
    """
    bare = lambda n: F.regexp_replace(F.lower(F.trim(n)), r"(?i)(\s*\(\d+\)|\s+\d+|\s*-?\s*copy(\s*\d+)?)$", "")
    own, whole = bare(folder), bare(F.regexp_replace(container, r"(?<=.)\.[^.]*$", ""))
    fits = lambda a, b: (a == b) | ((b == "x") & a.rlike(r"^\p{L}$")) | ((b == "0") & a.rlike(r"^\p{Nd}$"))
    letters = F.zip_with(F.split(own, ""), F.split(whole, ""), fits)
    return (F.length(own) == F.length(whole)) & F.forall(letters, lambda x: x)


def list_name(item_name: Column) -> Column:
    """The suggested name of a list whose items are annotated."""
    return F.concat(F.lit("List of "), item_name)


def statement(actor: Column, activity: Column, object_: Column, target: Column) -> Column:
    """The filled slots of a representation in order; empty if there is none."""
    return F.concat_ws(" · ", actor, activity, object_, target)
