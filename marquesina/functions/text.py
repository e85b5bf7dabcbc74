"""Text normalisation as native column expressions (no Python in the tasks)."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

# Unicode white space as the reference's runtime sees it: the property plus four separators.
SPACE = r"[\s\x{1c}-\x{1f}]"
NON_WORD = r"(?U)[^\p{L}\p{N}_\s\x{1c}-\x{1f}]"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``; keeps deep expressions from repeating it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, rf"(?U){SPACE}+", " "))


def blank_to_null(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


@lru_cache(maxsize=None)
def _folding(form: str, marks: str) -> tuple[str, str, str, str]:
    """Tables derived from the Unicode database for one decomposition form.

    Returns (single sources, single targets, a map literal of the longer expansions, and a
    character class of the characters needing it). ``marks`` says which marks are dropped.
    """
    def dropped(ch: str) -> bool:
        if marks == "combining":
            return unicodedata.combining(ch) != 0
        return 0x300 <= ord(ch) <= 0x36F

    kept, gone, longer = [], [], []
    for cp in range(0x80, 0x30000):
        if 0xD800 <= cp <= 0xDFFF or 0xAC00 <= cp <= 0xD7A3:
            continue
        ch = chr(cp)
        target = "".join(c for c in unicodedata.normalize(form, ch) if not dropped(c))
        if target == ch:
            continue
        if not target:
            gone.append(ch)
        elif len(target) == 1:
            kept.append((ch, target))
        else:
            longer.append((ch, target))
    sources = "".join(c for c, _ in kept) + "".join(gone)
    targets = "".join(t for _, t in kept)
    expansions = "\x01".join(f"{c}\x02{t}" for c, t in longer)
    return sources, targets, expansions, _char_class([ord(c) for c, _ in longer])


def _char_class(points: list[int]) -> str:
    runs: list[list[int]] = []
    for p in points:
        if runs and p == runs[-1][1] + 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in runs) + r"\x{ac00}-\x{d7a3}]"


def _syllable(c: Column) -> Column:
    """Split a Hangul syllable into its letters by the arithmetic of the standard."""
    index = F.ascii(c) - F.lit(0xAC00)
    def pick(first: int, count: int, at: Column) -> Column:
        letters = "".join(chr(first + i) for i in range(count))
        return F.lit(letters).substr(at.cast("int") + 1, F.lit(1))
    lead = pick(0x1100, 19, F.floor(index / 588))
    vowel = pick(0x1161, 21, F.floor((index % 588) / 28))
    tail = F.when(index % 28 > 0, pick(0x11A8, 27, index % 28 - 1)).otherwise(F.lit(""))
    return F.concat(lead, vowel, tail)


def _decompose(c: Column, form: str, marks: str) -> Column:
    sources, targets, expansions, rare = _folding(form, marks)
    table = F.str_to_map(F.lit(expansions), F.lit("\x01"), F.lit("\x02"))
    expanded = lambda simple: F.array_join(
        F.transform(
            F.split(simple, ""),
            lambda ch: F.when(F.ascii(ch).between(0xAC00, 0xD7A3), _syllable(ch))
            .when(ch.rlike(rare), F.coalesce(table[ch], ch))
            .otherwise(ch),
        ),
        "",
    )
    # Almost no text holds characters that expand to several, so most rows stop at translate, which runs once.
    translated = let(F.translate(c, sources, targets), lambda simple: F.when(simple.rlike(rare), expanded(simple)).otherwise(simple))
    return F.when(~c.rlike(r"[^\x00-\x7f]"), c).otherwise(translated)


def unaccent_nfkd(c: Column) -> Column:
    """Compatibility decomposition without combining marks."""
    return _decompose(c, "NFKD", "combining")


def normalize_folded(c: Column) -> Column:
    """The part of :func:`normalize_name` that follows the removal of accents."""
    plain = F.lower(strip(F.replace(c, F.lit("_"), F.lit(""))))
    return collapse(F.regexp_replace(plain, NON_WORD, " "))


def normalize_name(c: Column) -> Column:
    """Lower-case, accent-free, punctuation as spaces, white space collapsed (H1)."""
    return normalize_folded(unaccent_nfkd(c))


def normalize_for_search(c: Column) -> Column:
    """Accent-free lower case with straight apostrophes (H14); null becomes empty."""
    folded = _decompose(F.coalesce(c, F.lit("")), "NFD", "range")
    return F.lower(F.regexp_replace(folded, "[‘’]", "'"))


def display_name(short_name: Column, name: Column) -> Column:
    """Short name or name, cut to 35 characters and an ellipsis beyond 40."""
    shown = F.coalesce(blank_to_null(short_name), blank_to_null(name), F.lit(""))
    return F.when(F.length(shown) > 40, F.concat(F.substring(shown, 1, 35), F.lit("…"))).otherwise(shown)


# The five entities of markup and the non-breaking space.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def decode_entities(c: Column) -> Column:
    """Common markup entities to characters; the ampersand last, so nothing decodes twice."""
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def escape_markup(c: Column) -> Column:
    for char, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")]:
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def emphasis_to_tags(c: Column) -> Column:
    """Markdown bold and italics to tags; underscores inside words stay."""
    for pattern, tag in [
        (r"\*\*(.*?)\*\*", "strong"),
        (r"(?<!\w)__(.*?)__(?!\w)", "strong"),
        (r"\*(.*?)\*", "em"),
        (r"(?<!\w)_(.*?)_(?!\w)", "em"),
    ]:
        c = F.regexp_replace(c, pattern, f"<{tag}>$1</{tag}>")
    return c


def hostname(url: Column) -> Column:
    """Lower-case host without port or user; empty when there is none."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))


# Fixed value: the address form of a profile post.
POST_ADDRESS = r"instagram\.com/(?:p|reel|tv)/([^/?&]+)"


def post_code(url: Column) -> Column:
    """The short code of a post address, or the text itself when it is not an address."""
    code = F.regexp_extract(url, POST_ADDRESS, 1)
    return F.when(code != "", code).otherwise(F.regexp_replace(url, "^/+|/+$", ""))


def leading_url(content: Column) -> Column:
    """First line when the content starts with an address and has a second line."""
    return F.when(
        content.startswith("http") & (F.instr(content, "\n") > 0),
        strip(F.substring_index(content, "\n", 1)),
    )


def body_after_url(content: Column) -> Column:
    cut = F.instr(content, "\n")
    return F.when(content.startswith("http") & (cut > 0), F.substr(content, cut + 1)).otherwise(content)


def image_urls(content: Column, base_url: str | None = None) -> Column:
    """Addresses of markdown images, without inline data and decoration."""
    found = F.regexp_extract_all(content, F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), F.lit(1))
    wanted = F.filter(
        found, lambda u: ~u.startswith("data:") & ~F.lower(u).rlike("icon|button|logo")
    )
    if base_url:
        site = "/".join(base_url.split("/")[:3])
        folder = base_url.rsplit("/", 1)[0] + "/" if base_url.count("/") > 2 else base_url + "/"
        wanted = F.transform(
            wanted,
            lambda u: F.when(u.rlike("^https?://"), u)
            .when(u.startswith("//"), F.concat(F.lit(site.split("//")[0]), u))
            .when(u.startswith("/"), F.concat(F.lit(site), u))
            .otherwise(F.concat(F.lit(folder), u)),
        )
    return F.filter(wanted, lambda u: u.rlike("^https?://"))


def is_country_flag(c: Column) -> Column:
    """Only regional-indicator letters, at least one."""
    return F.coalesce(c.rlike(r"^[\x{1F1E6}-\x{1F1FF}]+\z"), F.lit(False))


def is_valid_url(c: Column) -> Column:
    return F.coalesce(c.startswith("http://") | c.startswith("https://"), F.lit(False))


# Glyphs that render as plain boxes and do not count as an emoji.
BLOCKED_GLYPHS = ["⬜", "□", "◻", "⬛", "■", "▪", "▫", "◼", "◾", "◽", "◿", "▢", "▣", "▤", "▥", "▦", "▧", "▨", "▩"]
# The code-point ranges that count as an emoji base.
GLYPH_RANGES = [
    (0x1F300, 0x1F5FF), (0x1F600, 0x1F64F), (0x1F680, 0x1F6FF), (0x1F700, 0x1F77F), (0x1F780, 0x1F7FF),
    (0x1F800, 0x1F8FF), (0x1F900, 0x1F9FF), (0x1FA00, 0x1FA6F), (0x1FA70, 0x1FAFF),
    (0x2600, 0x26FF), (0x2700, 0x27BF), (0x25A0, 0x25FF), (0x2B00, 0x2BFF),
]
_BASE = (
    r"(?:[\x{1F1E6}-\x{1F1FF}]{2}|["
    + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in GLYPH_RANGES)
    + "])"
)
_PART = _BASE + r"[\x{FE0E}\x{FE0F}]?[\x{1F3FB}-\x{1F3FF}]?"
GLYPH = rf"{_PART}(?:\x{{200D}}{_PART})*"


def first_emoji(c: Column) -> Column:
    """First glyph cluster that is not blocked."""
    found = F.regexp_extract_all(c, F.lit(GLYPH), F.lit(0))
    return F.try_element_at(F.filter(found, lambda g: ~g.isin(BLOCKED_GLYPHS)), F.lit(1))


def without_leading_emoji(c: Column) -> Column:
    """The text after the first accepted glyph when only blanks and glyphs come before it."""
    glyph = first_emoji(c)
    blocked = "(?:" + "|".join(BLOCKED_GLYPHS) + ")"
    lead = rf"(?U)^(?:{SPACE}|{blocked}(?![\x{{FE0E}}\x{{FE0F}}\x{{200D}}\x{{1F3FB}}-\x{{1F3FF}}]))*+{GLYPH}{SPACE}*"
    return F.when(glyph.isNotNull(), F.regexp_replace(c, lead, "")).otherwise(c)


def short_name(name: Column, venue: Column) -> Column:
    """Name without the exhibition prefix and without the trailing venue."""
    bare = F.regexp_replace(name, rf"(?U)^Exhibition:{SPACE}*", "")
    suffix = F.concat(F.lit(" - at "), blank_to_null(venue))
    cut = F.when(
        F.coalesce(F.endswith(bare, suffix), F.lit(False)),
        F.left(bare, F.length(bare) - F.length(suffix)),
    ).otherwise(bare)
    return strip(cut)


def relative_time(at: Column, now: Column) -> Column:
    """Human label of the time since ``at``."""
    s = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 1_000_000
    def unit(size: int, suffix: str) -> Column:
        return F.concat(F.floor(s / size).cast("string"), F.lit(suffix))
    return (
        F.when(at.isNull(), "-")
        .when(s < 60, "just now")
        .when(s < 3600, unit(60, "m ago"))
        .when(s < 86400, unit(3600, "h ago"))
        .when(s < 172800, "yesterday")
        .when(s < 604800, unit(86400, "d ago"))
        .otherwise(F.date_format(at, "MMM dd"))
    )
