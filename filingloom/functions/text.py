"""Text of HTML documents: column functions, all native.

Three cleaners exist because filings need three: ``numbers.strip_markup``
removes entities, ``html_to_text`` leaves them, ``clean_text`` decodes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Named entities, the ampersand last, and the tags that end a paragraph.
ENTITIES = (
    ("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&mdash;", "—"), ("&ndash;", "–"), ("&rsquo;", "’"), ("&lsquo;", "‘"), ("&amp;", "&"),
)
BLOCK_TAGS = ("p", "div", "h[1-6]", "li", "ul", "ol", "tr", "table", "thead", "tbody", "section", "article", "header", "footer", "figure", "figcaption", "blockquote", "pre", "br", "hr", "dd", "dt", "caption")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, without case and outer white space; 1 for two empty texts."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(x, y) / longest)


def _without_code(col: Column, instead: str) -> Column:
    return F.regexp_replace(F.regexp_replace(col, "(?is)<script.*?</script>", instead), "(?is)<style.*?</style>", instead)


def html_to_text(html: Column) -> Column:
    """Text of the body: code dropped, tags to spaces, white space collapsed; entities stay."""
    body = F.regexp_extract(html, "(?is)<body.*?</body>", 0)
    bare = F.regexp_replace(_without_code(F.when(body == "", html).otherwise(body), ""), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(bare, "(?U)\\s+", " "))


def decode_numeric(col: Column) -> Column:
    """Decimal character references as their characters."""
    codes = F.regexp_extract_all(col, F.lit("&#(\\d+);"), F.lit(1))
    letters = F.transform(codes, lambda c: F.decode(F.unhex(F.lpad(F.hex(c.try_cast("bigint")), 8, "0")), "UTF-32"))
    between = F.split(col, "&#\\d+;")
    joined = F.array_join(F.zip_with(between, letters, lambda t, l: F.concat(t, F.coalesce(l, F.lit("")))), "")
    return F.when(F.size(codes) == 0, col).otherwise(joined)


def clean_text(fragment: Column) -> Column:
    """Text of a fragment: code and tags to spaces, entities decoded, white space collapsed."""
    text = decode_numeric(F.regexp_replace(_without_code(fragment, " "), "(?s)<[^>]+>", " "))
    for entity, letter in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(letter))
    return F.trim(F.regexp_replace(F.replace(text, F.lit(" "), F.lit(" ")), "(?U)\\s+", " "))


def body_of(html: Column) -> Column:
    """From the opening body tag to the last closing one; the whole document without one."""
    start = F.regexp_instr(html, F.lit("(?is)<body\\b[^>]*>"))
    after = F.substring(html, start, F.length(html))
    end = F.length(after) - F.instr(F.reverse(after), ">ydob/<") + 1
    closed = F.when(F.instr(after, "</body>") > 0, F.substring(after, F.lit(1), end)).otherwise(after)
    return F.when(start > 0, closed).otherwise(html)


def paragraphs(html: Column) -> Column:
    """The paragraphs of a document in order, cleaned, without empty ones."""
    body = _without_code(body_of(html), " ")
    broken = F.regexp_replace(body, f"(?is)</?(?:{'|'.join(BLOCK_TAGS)})\\b[^>]*>", "\n")
    return F.filter(F.transform(F.split(broken, "\n"), clean_text), lambda p: p != "")


def find_paragraphs(docs: DataFrame, query: str, *, keep: list[str], html_col: str, ignore_case: bool = True) -> DataFrame:
    """``keep`` columns, index (from 1, among all paragraphs) and paragraph of each that holds the phrase."""
    rows = docs.select(*keep, F.posexplode(paragraphs(F.col(html_col))).alias("at", "paragraph"))
    text, phrase = (F.lower("paragraph"), query.lower()) if ignore_case else (F.col("paragraph"), query)
    return rows.where(F.contains(text, F.lit(phrase))).select(*keep, (F.col("at") + 1).alias("index"), "paragraph")


def prose_markdown(text: Column) -> Column:
    """Prose with single blank lines."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "(?U)^\\s+", ""), "(?U)\\s+$", ""), "\\n[ \\t]*\\n[ \\t\\n]*", "\n\n")


#: Spacing of punctuation, running heads and feet of pages, and what is taken out of markup before parsing, in this order.
PUNCTUATION = (
    ("[—–]", " - "), ("(?U)\\s+([.,;!?])", "$1"), ("([,;])([A-Za-z])", "$1 $2"), ("(?<=\\w{2})([.!?])([A-Z])", "$1 $2"),
    ("(?<=[0-9])([.!?])([A-Z])", "$1 $2"), ("(%[.!?]?)([A-Za-z])", "$1 $2"), (" {2,}", " "),
)
NUMBER_LINE = "\\n\\s*\\d{1,3}\\s*\\n\\s*"
RUNNING = f"(?:{NUMBER_LINE}PART\\s+[IVX]+\\s*\\n\\s*Item\\s+\\d+[A-Za-z]?(?:,\\s*\\d+[A-Za-z]?)?|{NUMBER_LINE}Table of Contents)\\s*"
LAST_ITEM, LAST_NUMBER = "\\n\\s*Item\\s+\\d+[A-Za-z]?\\.?\\s*$", "\\n\\s*\\d{1,3}\\s*$"
PREPARATION = (
    ("^\\x{FEFF}", ""), ("<\\?xml[^>]*\\?>", ""), ("[\\x{91}\\x{92}]", "'"), ("[\\x{93}\\x{94}]", '"'), ("\\x{95}", "•"), ("\\x{96}", "–"), ("\\x{97}", "—"), ("[\\x{00}-\\x{08}\\x{0B}\\x{0C}\\x{0E}-\\x{1F}\\x{7F}]", ""),
    ("(?is)<(script|style|ix:hidden|ix:header)\\b[^>]*>.*?</\\1>", ""), ("(?i)<link[^>]*>", ""), ("(?s)<!--.*?-->", ""), ("&(?:nbsp|ensp|thinsp|#160|#32);|\\x{A0}", " "), ("&emsp;", "  "), ("&(?:zwj|zwnj|#8203);", ""),
)


def punctuated(col: Column) -> Column:
    """Even spacing of punctuation: dashes stand between spaces, marks follow their word and precede a space."""
    for pattern, instead in PUNCTUATION:
        col = F.regexp_replace(col, pattern, instead)
    return F.trim(col)


def without_page_marks(col: Column) -> Column:
    """A section's text without the page headers inside it and the page footer, item heading or page number at its end."""
    for pattern, instead in ((f"(?i){RUNNING}\\n", "\n\n"), (f"(?i){RUNNING}$", ""), (f"(?i){LAST_ITEM}", ""), (LAST_NUMBER, "")):
        col = F.regexp_replace(col, pattern, instead)
    return F.regexp_replace(col, "(?U)\\s+$", "")


def shortened(col: Column, length: int | Column) -> Column:
    """At most ``length`` characters: cut at a sentence or line end in the last fifth, else at a space in the last tenth, else hard with three dots."""
    length = F.lit(length)
    head = F.left(col, length)
    last = lambda mark: F.when(F.instr(head, mark) > 0, length - F.instr(F.reverse(head), mark) + 1).otherwise(0)
    stop, space = F.greatest(last("."), last("\n")), last(" ")
    cut = (
        F.when(stop > 0.8 * length, F.trim(F.substring(col, F.lit(1), stop)))
        .when(space > 0.9 * length, F.concat(F.trim(F.substring(col, F.lit(1), space - 1)), F.lit("...")))
        .otherwise(F.concat(F.trim(F.left(col, F.greatest(F.lit(0), length - 3))), F.lit("...")))
    )
    return F.when(F.length(col) <= length, col).otherwise(cut)


def preprocessed(html: Column) -> Column:
    """Markup before parsing: no byte-order mark, XML declaration, control characters, code, comments or hidden XBRL."""
    for pattern, instead in PREPARATION:
        html = F.regexp_replace(html, pattern, instead)
    return html
