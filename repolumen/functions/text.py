"""Text, URL and file-name expressions. Lengths are in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space and line terminators removed at both ends of a text.
TRIM_CODE_POINTS = (
    0x0009, 0x000A, 0x000B, 0x000C, 0x000D, 0x0020, 0x00A0, 0x1680,
    0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007,
    0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF,
)
TRIM_CHARS = "".join(chr(p) for p in TRIM_CODE_POINTS)

# Limits and markers of the corpus.
HOST = "github.com"
HOST_PREFIX = "https://github.com/"
MIN_README_CHARS = 500
MAX_README_CHARS = 50_000
TRUNCATION_MARK = "\n\n[TRUNCATED]"
MIN_EMBED_CHARS = 10
MAX_EMBED_CHARS = 16_000
MAX_FILE_KEY_CHARS = 200
STRICT_BRANCHES = ("main", "master", "default")
EXTENDED_BRANCHES = ("main", "master", "default", "HEAD")
CONTENT_BRANCHES = ("HEAD", "master", "main")


def unicode_trim(text: Column) -> Column:
    return F.btrim(text, F.lit(TRIM_CHARS))


def is_embeddable(content: Column, min_chars: int = MIN_EMBED_CHARS) -> Column:
    return F.char_length(unicode_trim(content)) >= min_chars


def embed_text(content: Column, max_chars: int = MAX_EMBED_CHARS) -> Column:
    """The text handed to the embedder: trimmed first, then cut."""
    return F.substring(unicode_trim(content), 1, max_chars)


def truncate_marked(content: Column, max_chars: int = MAX_README_CHARS) -> Column:
    """Cut over-long content and say so; the mark comes on top of ``max_chars``."""
    cut = F.concat(F.substring(content, 1, max_chars), F.lit(TRUNCATION_MARK))
    return F.when(F.char_length(content) > max_chars, cut).otherwise(content)


def repo_from_url(url: Column, host: str = HOST) -> Column:
    """``owner/name`` out of an origin URL without a trailing ``.git``; null if none."""
    pattern = host.replace(".", r"\.") + r"/([^/]+/[^/]+)"
    repo = F.regexp_replace(F.regexp_extract(url, pattern, 1), r"\.git$", "")
    return F.when(F.regexp_like(url, F.lit(pattern)), repo)


def file_key(repo: Column) -> Column:
    """Flat key of a repository: the first slash becomes an underscore."""
    return F.regexp_replace(repo, r"^([^/]*)/", "$1_")


def repo_page_url(repo: Column, prefix: str = HOST_PREFIX) -> Column:
    return F.concat(F.lit(prefix), repo)


def _branch_index(parts: Column, branches: tuple[str, ...]) -> Column:
    """Zero-based index of the first part that is a branch name; null if none is."""
    wanted = F.array(*[F.lit(b) for b in branches])
    marked = F.transform(parts, lambda p, i: F.when(F.array_contains(wanted, p), i))
    return F.get(F.filter(marked, lambda i: i.isNotNull()), F.lit(0))


def _repo_name(parts: Column, end: Column) -> Column:
    tail = F.slice(parts, F.lit(2), F.greatest(end - 1, F.lit(0)))
    return F.concat(parts[0], F.lit("/"), F.array_join(tail, "_"))


def stored_name_repo(name: Column, branches: tuple[str, ...] = STRICT_BRANCHES) -> Column:
    """Repository of a stored ``owner_repo_branch_file`` name.

    The first branch token decides; it must leave at least owner and one repo
    token in front, else the name is rejected (null).
    """
    parts = F.split(name, "_")
    at = _branch_index(parts, branches)
    return F.when(at >= 2, _repo_name(parts, at))


def stored_name_repo_lenient(
    name: Column, branches: tuple[str, ...] = STRICT_BRANCHES
) -> Column:
    """As :func:`stored_name_repo`, but never rejects.

    Without a branch token the last two tokens are taken as branch and file. As
    ends are slice bounds, a negative one counts from the back.
    """
    parts = F.split(name, "_")
    n = F.size(parts)
    at = F.coalesce(_branch_index(parts, branches), n - 2)
    end = F.when(at < 0, n + at).otherwise(at)
    return _repo_name(parts, end)


def stored_name_branch(name: Column, branches: tuple[str, ...] = STRICT_BRANCHES) -> Column:
    parts = F.split(name, "_")
    return F.get(parts, _branch_index(parts, branches))


def stored_name_file(name: Column, branches: tuple[str, ...] = STRICT_BRANCHES) -> Column:
    parts = F.split(name, "_")
    at = _branch_index(parts, branches)
    return F.array_join(F.slice(parts, at + 2, F.size(parts)), "_")


def finished_file_key(name: Column) -> Column:
    """File key of an already stored document: all but its last two tokens."""
    parts = F.split(name, "_")
    n = F.size(parts)
    return F.when(n >= 3, F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 2, F.lit(0))), "_"))
