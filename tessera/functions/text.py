"""Text functions as column expressions; all but top_words stay in the JVM."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.batches import READ

#: White space that stripping removes.
BLANK = " \t\n\r\f"
ZH = "[\\u4e00-\\u9fff]"


def clean_text(text: Column) -> Column:
    """Line ends as \\n, at most one blank line in a row, single spaces, stripped."""
    t = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.btrim(F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), " {2,}", " "), F.lit(BLANK))


def token_estimate(text: Column) -> Column:
    """1.5 Chinese or 4 other characters a token, rounded down."""
    zh = F.regexp_count(text, F.lit(ZH))
    return F.floor(zh / F.lit(1.5) + (F.length(text) - zh) / F.lit(4.0)).cast("long")


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def snippet(text: Column, term: str, around: int = 50) -> Column:
    """The first match with up to `around` characters on either side, dots where it is cut; the start if there is none."""
    at = F.greatest(F.locate(term.lower(), F.lower(text)) - 1, F.lit(0))
    begin = F.greatest(at - around, F.lit(0))
    end = F.least(at + len(term) + around, F.length(text))
    dots = lambda c: F.when(c, F.lit("...")).otherwise(F.lit(""))
    return F.concat(dots(begin > 0), F.substring(text, begin + 1, end - begin), dots(end < F.length(text)))


def safe_filename(title: Column) -> Column:
    """The first 50 characters without any but letters, digits, spaces, - and _, stripped."""
    return F.btrim(F.regexp_replace(F.left(title, F.lit(50)), r"(?U)[^\p{L}\p{N} \-_]", ""))


def file_type(name: Column) -> Column:
    """The extension of a path's last part in lower case; txt where there is none. Dots at its beginning begin no extension."""
    last = F.regexp_replace(F.regexp_extract(name, r"[^/]*$", 0), r"^\.+", "")
    ext = F.lower(F.regexp_extract(last, r"(?s)^[^.].*\.([^.]*)$", 1))
    return F.when(ext == "", "txt").otherwise(ext)


def html_to_text(html: Column) -> Column:
    """Without scripts, styles and tags, white space as single spaces, stripped."""
    t = F.regexp_replace(html, r"(?s)<script[^>]*>.*?</script>", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<style[^>]*>.*?</style>", ""), r"<[^>]+>", " ")
    return F.btrim(F.regexp_replace(t, r"\s+", " "), F.lit(BLANK))


def strip_tags(html: Column) -> Column:
    """Without tags, four entities resolved, the ampersand first."""
    t = F.regexp_replace(html, r"<[^>]+>", "")
    for entity, c in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        t = F.replace(t, F.lit(entity), F.lit(c))
    return F.btrim(t, F.lit(BLANK))


def arxiv_id(text: Column) -> Column:
    """Without the arxiv: prefix and a version at the end."""
    return F.btrim(F.regexp_replace(F.regexp_replace(text, "(?i)^arxiv:", ""), r"v\d+$", ""))


# fixed values: the stop words
STOP_WORDS = ["的", "是", "在", "和", "了", "有", "不", "这", "为", "上", "the", "a", "an", "is", "are", "was", "were", "be", "been", "to", "of", "and", "in", "that", "it", "for", "on", "with"]
_WORDS = re.compile(r"[\u4e00-\u9fff]+|[a-z]+")


_TOP = pa.list_(pa.struct({"word": pa.string(), "n": pa.int64()}))


def _counted(text: str, stop: frozenset[str]) -> Counter[str]:
    return Counter(w for m in _WORDS.finditer(text) if len(w := m.group()) > 1 and w not in stop)


def _tops(texts: pa.Array, most: int, stop: frozenset[str]) -> pa.Array:
    """The most frequent words of each text, a few texts at a time, as an Arrow batch holds 10,000 of them."""
    top = lambda x: [{"word": w, "n": n} for w, n in _counted(x.as_py() or "", stop).most_common(most)]
    return pa.concat_arrays([pa.array([top(x) for x in texts.slice(lo, READ)], _TOP) for lo in range(0, max(len(texts), 1), READ)])


def top_words(lowered: Column, most: int) -> Column:
    """word and n of the most frequent words of Chinese or Latin letters over one character that are no stop words; of equals the one that comes first. Null text has none."""
    stop = frozenset(STOP_WORDS)

    @F.arrow_udf("array<struct<word:string,n:long>>")
    def top(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            yield _tops(t, most, stop)

    return top(lowered)


def within(text: Column, tag: str) -> Column:
    """What stands in the first <tag>...</tag>, stripped; null where there is none."""
    pattern = f"(?s)<{tag}>(.*?)</{tag}>"
    return F.when(F.regexp_like(text, F.lit(pattern)), F.btrim(F.regexp_extract(text, pattern, 1), F.lit(BLANK)))


def author_names(authors: Column) -> Column:
    return F.transform(authors, lambda a: F.coalesce(a["name"], F.lit("")))


def author_display(authors: Column, most: int = 3) -> Column:
    """The first names joined by commas, and et al. if there are more."""
    names = F.array_join(F.slice(author_names(authors), 1, most), ", ")
    return F.when(F.size(authors) > most, F.concat(names, F.lit(" et al."))).otherwise(names)


def node_size(citations: Column) -> Column:
    """Grows with the logarithm of citations, from 15 to 25."""
    return F.least(15 + F.ln(citations + 1) * 3, F.lit(25.0))


def vector_of(text: Column) -> Column:
    """The array that a text like [x,y] spells; null where it spells none."""
    return F.from_json(text, "array<float>")


def vector_text(vector: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(vector.cast("array<string>"), ","), F.lit("]"))


def iso_time(time: Column) -> Column:
    """ISO 8601 with microseconds, which are left out where they are zero."""
    return F.when(F.date_format(time, "SSSSSS") == "000000", F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def first_entries(pairs: Column, n: int) -> Column:
    """The first n entries of a map, in its order."""
    return F.slice(F.map_entries(pairs), 1, n)


def citation(authors: Column, title: Column, venue: Column, year: Column) -> Column:
    who = F.coalesce(F.nullif(F.array_join(author_names(authors), ", "), F.lit("")), F.lit("Unknown"))
    return F.concat(who, F.lit('. "'), title, F.lit('". '), F.coalesce(venue, F.lit("")), F.lit(" ("), F.coalesce(year.cast("string"), F.lit("")), F.lit(")"))


# fixed values: what a host must not contain, and how it must not start
REFUSED_INSIDE = ("localhost", "127.0.0.1", "0.0.0.0", "internal", "intranet", "private", "corp")
REFUSED_STARTS = ("10.", "172.", "192.168.")


def url_error(url: Column) -> Column:
    """Why an address isn't allowed: invalid_protocol, blocked_domain or private_ip, the first that holds; null if it is."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://(?:[^/?#]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    inside, starts = F.lit(False), F.lit(False)
    for x in REFUSED_INSIDE:
        inside = inside | host.contains(x)
    for x in REFUSED_STARTS:
        starts = starts | host.startswith(x)
    known = F.coalesce(F.regexp_like(url, F.lit(r"^(?i:https?)://")), F.lit(False))
    return F.when(~known, "invalid_protocol").when(inside, "blocked_domain").when(starts, "private_ip")


def url_allowed(url: Column) -> Column:
    """http or https, and no local, private or internal host."""
    return url_error(url).isNull()


def package_name(text: Column) -> Column:
    return F.lower(F.btrim(F.split(text, "[<>=!~]")[0]))


def numbered(rows: Column, title: str, *more: str) -> Column:
    """A text of numbered blocks from an array of structs: n. title, and below it the given fields that aren't empty."""
    def block(r: Column, i: Column) -> Column:
        lines = F.array(F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(r[title], F.lit(""))), *[F.when(F.coalesce(r[m], F.lit("")) != "", F.concat(F.lit("   "), r[m])) for m in more])
        return F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")

    return F.array_join(F.transform(rows, block), "\n")
