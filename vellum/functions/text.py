"""Text functions as Column expressions. Python semantics are kept where they differ from Java's: Unicode white space and word characters, stripping of all white space, spans with offsets."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"


def chain(text: Column, rules) -> Column:
    """Applies (pattern, replacement[, times]) in order."""
    for pattern, put, *times in rules:
        for _ in range(times[0] if times else 1):
            text = F.regexp_replace(text, pattern, put)
    return text


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """Every run of white space becomes one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def shorten(text: Column, n: int) -> Column:
    """Squeezed text of at most n characters; a cut one ends with an ellipsis."""
    s = squeeze(F.coalesce(text, F.lit("")))
    return F.when(F.length(s) <= n, s).otherwise(F.concat(F.regexp_replace(F.substring(s, 1, n - 1), r"(?U)\s+$", ""), F.lit("…")))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once and not once per place it stands in."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


SPAN_BLOCK = 64


def spans(text: Column, pattern: str) -> Column:
    """All matches of a pattern that never matches nothing: array of (start, end, match), offsets in code points from 0.

    Offsets are sums of what stands before, taken per block of matches and then within a block.
    """
    named = lambda **parts: F.named_struct(*[x for k, v in parts.items() for x in (F.lit(k), v)])
    total = lambda parts: F.aggregate(parts, F.lit(0), lambda n, x: n + x)

    def sized(s: Column) -> Column:
        before, size = F.transform(s["gaps"], F.length), F.transform(s["hits"], F.length)
        return named(hits=s["hits"], before=before, steps=F.zip_with(before, size, lambda a, b: a + F.coalesce(b, F.lit(0))))

    def blocked(s: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.floor(F.size(s["hits"]) / SPAN_BLOCK).cast("int")), lambda b: total(F.slice(s["steps"], b * SPAN_BLOCK + 1, F.lit(SPAN_BLOCK))))
        return named(hits=s["hits"], before=s["before"], steps=s["steps"], blocks=each)

    def summed(s: Column) -> Column:
        sums = F.transform(s["blocks"], lambda _, b: total(F.slice(s["blocks"], F.lit(1), b)))
        return named(hits=s["hits"], before=s["before"], steps=s["steps"], sums=sums)

    def placed(s: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            block = F.floor(i / SPAN_BLOCK).cast("int")
            start = F.get(s["sums"], block) + total(F.slice(s["steps"], block * SPAN_BLOCK + 1, i - block * SPAN_BLOCK)) + F.get(s["before"], i)
            return named(start=start, end=start + F.length(m), match=m)

        return F.transform(s["hits"], one)

    found = named(gaps=F.split(text, pattern, -1), hits=F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return bind(bind(bind(bind(found, sized), blocked), summed), placed)


def group(match: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract(match, pattern, n)


# Where a sentence ends, and how far around a match it is looked for.
SENTENCE_BOUNDARY = r"(?<=[.!?])(?U:\s)+(?=[A-Z\[\(])|\n(?U:\s)*\n"
SENTENCE_REACH = 600


def sentence_around(text: Column, start: Column, end: Column) -> Column:
    """The sentence that holds a span. Boundaries are looked for in a window around it; one that straddles the span's start counts for neither side."""
    first = F.greatest(F.lit(0), start - SENTENCE_REACH)
    window = F.substring(text, first + 1, end + SENTENCE_REACH - first)
    at = start - first
    cuts = spans(window, SENTENCE_BOUNDARY)
    left = F.coalesce(F.array_max(F.transform(F.filter(cuts, lambda c: c["end"] <= at), lambda c: c["end"])), F.lit(0))
    right = F.coalesce(F.array_min(F.transform(F.filter(cuts, lambda c: c["start"] >= at), lambda c: c["start"])), F.length(window))
    return squeeze(F.substring(window, left + 1, right - left))


# ---- TeX ----

# Comments, formatting commands, and the steps by which each kind of fragment is read.
COMMENT = r"(?<!\\)%[^\n]*"
FORMATTERS = ["textbf", "textit", "emph", "texttt", "textsc", "textrm", "textsf"]
PROSE_FORMATTERS = [*FORMATTERS, "textnormal", "underline", "mathbf", "mathit", "mathrm", "mathsf"]
ANY_COMMAND = r"\\[a-zA-Z]+\*?"
ONE_ARGUMENT = ANY_COMMAND + r"(?:\[[^\]]*\])?\s*\{([^{}]*)\}"
DROPPED_ENVIRONMENTS = [
    "figure", "figure*", "table", "table*", "equation", "equation*", "align", "align*", "gather", "gather*", "tikzpicture",
    "algorithm", "algorithmic", "verbatim", "lstlisting", "Verbatim", "tabular", "tabularx", "array", "matrix", "thebibliography",
]
CITE_COMMANDS = ["cite", "citep", "citet", "citealp", "citealt", "citeauthor", "citeyear", "citenum", "parencite", "textcite", "fullcite", "Citep", "Citet", "Cite"]
REF_COMMANDS = ["ref", "eqref", "cref", "Cref", "pageref", "autoref", "nameref"]
DROPPED_WITH_ARGUMENT = ["input", "include", "includegraphics", "usepackage", "bibliography", "bibliographystyle", "addbibresource"]
HEADINGS = ["section", "subsection", "subsubsection", "paragraph", "subparagraph", "chapter"]
CITE = r"\\(?:" + "|".join(CITE_COMMANDS) + r")\*?(?:\[[^\]]*\])?(?:\[[^\]]*\])?\{([^{}]*)\}"
CITE_MARK = r"\[CITE:[^\]]*\]"


def _formatters(names: list[str], space: str = "") -> str:
    return r"\\(?:" + "|".join(names) + ")" + space + r"\{([^{}]*)\}"


def strip_comments(text: Column) -> Column:
    return F.regexp_replace(text, COMMENT, "")


def flatten_tex(text: Column) -> Column:
    """Readable text of a fragment; arguments of commands stay."""
    return squeeze(chain(text, [(_formatters(FORMATTERS), "$1", 4), (ONE_ARGUMENT, "$1", 4), (ANY_COMMAND, " "), (r"[{}]", ""), ("~", " ")]))


def flatten_answer(text: Column) -> Column:
    """As flatten_tex, but commands lose only their names."""
    return squeeze(chain(text, [(_formatters(FORMATTERS, r"\s*"), "$1", 3), (ANY_COMMAND, " "), (r"[{}]", ""), ("~", " ")]))


def clean_bib_value(text: Column) -> Column:
    return squeeze(chain(text, [(_formatters(FORMATTERS), "$1", 3), (r"""(?U)\\[`'"^~=.]\{?(\w)\}?""", "$1"), (r"\\(ss|aa|AA|oe|OE|ae|AE|o|O|l|L)\b", "$1"), (ANY_COMMAND, ""), (r"[{}]", ""), ("~", " ")]))


def mark_citations(text: Column) -> Column:
    r"""\cite{a, b} becomes [CITE:a,b]."""
    gaps = F.split(text, CITE, -1)
    keys = F.regexp_extract_all(text, F.lit(CITE), F.lit(1))
    mark = lambda gap, k: F.concat(gap, F.coalesce(F.concat(F.lit("[CITE:"), F.regexp_replace(k, SPACE, ""), F.lit("]")), F.lit("")))
    return F.array_join(F.zip_with(gaps, keys, mark), "")


def tex_body(text: Column) -> Column:
    """The prose of a TeX source, with citation marks; mathematics, floats and references go."""
    text = strip_comments(text)
    begin, end = r"\\begin\s*\{document\}", r"\\end\s*\{document\}"
    text = chain(text, [(rf"(?s)\A.*?{begin}", ""), (rf"(?s){end}.*\z", "")])
    environments = [(r"(?s)\\begin\s*\{" + e.replace("*", r"\*") + r"\}.*?\\end\s*\{" + e.replace("*", r"\*") + r"\}", " ") for e in DROPPED_ENVIRONMENTS]
    math = [(r"(?s)\\\[.*?\\\]", " "), (r"(?s)\\\(.*?\\\)", " "), (r"(?s)\$\$.*?\$\$", " "), (r"(?<!\\)\$[^$\n]{0,200}?(?<!\\)\$", " ")]
    text = mark_citations(chain(text, environments + math))
    text = chain(text, [
        (r"\\(?:label|" + "|".join(REF_COMMANDS) + r")\s*\{[^{}]*\}", ""),
        (r"\\(?:" + "|".join(DROPPED_WITH_ARGUMENT) + r")\s*(?:\[[^\]]*\])?\s*\{[^{}]*\}", ""),
        (r"\\(?:" + "|".join(HEADINGS) + r")\*?\s*\{([^{}]*)\}", "\n\n$1\n"),
        (_formatters(PROSE_FORMATTERS, r"\s*"), "$1", 4),
        (ONE_ARGUMENT, "$1", 4),
        (ANY_COMMAND, " "),
        ("~", " "),
        (r"[{}]", ""),
        (r"[ \t]+", " "),
        (r"\n{3,}", "\n\n"),
    ])
    return strip(text)


def tex_title(text: Column) -> Column:
    raw = F.regexp_extract(text, r"\\title\s*\{((?:[^{}]|\{[^{}]*\})*)\}", 1)
    rules = [(_formatters(FORMATTERS), "$1", 4), (ANY_COMMAND + r"(?:\[[^\]]*\])?\{([^{}]*)\}", "$1"), (ANY_COMMAND, " "), (r"[{}]", "")]
    return blank_to_null(squeeze(chain(raw, rules)))


def tex_abstract(text: Column) -> Column:
    raw = F.regexp_extract(text, r"(?s)\\begin\s*\{abstract\}(.*?)\\end\s*\{abstract\}", 1)
    return blank_to_null(squeeze(F.regexp_replace(tex_body(raw), CITE_MARK, "")))


TABLE_ENVIRONMENT = r"(?s)\\begin\s*\{(table\*?|tabular\*?|tabularx|longtable)\}(.*?)\\end\s*\{\1\}"
ACKNOWLEDGMENT_ENVIRONMENT = r"(?is)\\begin\s*\{(acks|acknowledgements?|acknowledgments?)\}(.*?)\\end\s*\{\1\}"
ACKNOWLEDGMENT_HEADING = r"(?i)\\(?:section|subsection|paragraph)\*?\s*\{\s*acknowledge?ments?\s*\}"
SECTION_BOUNDARY = r"(?i:\\(?:section|subsection|chapter|paragraph)\b|\\(?:bibliography|printbibliography)\b|\\begin\s*\{thebibliography\}|\\end\s*\{document\})"


def table_bodies(text: Column) -> Column:
    return F.regexp_extract_all(strip_comments(text), F.lit(TABLE_ENVIRONMENT), F.lit(2))


def tex_acknowledgments(text: Column) -> Column:
    text = strip_comments(text)
    heading = rf"(?s)(?:{ACKNOWLEDGMENT_HEADING})(.*?)(?:{SECTION_BOUNDARY}|\z)"
    environment = F.regexp_like(text, F.lit(ACKNOWLEDGMENT_ENVIRONMENT))
    found = F.when(environment, F.regexp_extract(text, ACKNOWLEDGMENT_ENVIRONMENT, 2)).otherwise(F.regexp_extract(text, heading, 1))
    return blank_to_null(flatten_tex(found))


def tex_sections(text: Column) -> Column:
    titles = F.regexp_extract_all(strip_comments(text), F.lit(r"\\section\*?\s*\{((?:[^{}]|\{[^{}]*\})*)\}"), F.lit(1))
    return F.filter(F.transform(titles, flatten_tex), lambda t: t != "")


# ---- extracted pages ----

# The heading of a bibliography, and where an abstract stands on a first page.
REFERENCES_HEADING = r"(?imd)^\s*(?:\d+\.?\s+)?(?:References|Bibliography|Works\s+Cited|Literature\s+Cited|R\s*E\s*F\s*E\s*R\s*E\s*N\s*C\s*E\s*S)\s*$"
ABSTRACT_ON_PAGE = r"(?isd)(?:^|\n)\s*A\s*b\s*s\s*t\s*r\s*a\s*c\s*t\s*[\.\:\-]?\s*\n+(.+?)(?=\n\s*(?:1\.?\s+)?(?:Introduction|Background|Keywords)\b)"


def join_pages(pages: Column) -> Column:
    return chain(F.array_join(pages, "\n", ""), [(r"(?U)-\s*\n\s*(\w)", "$1"), (r"\n{3,}", "\n\n")])


def page_title(text: Column) -> Column:
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"), strip)
    return F.get(F.filter(lines, lambda x: (F.length(x) >= 8) & (F.length(x) <= 250)), F.lit(0))


def page_abstract(text: Column) -> Column:
    return blank_to_null(squeeze(F.regexp_extract(F.substring(text, 1, 8000), ABSTRACT_ON_PAGE, 1)))


def references_page(pages: Column) -> Column:
    """The last page (from 1) with the heading; null if none has it."""
    return F.array_max(F.transform(F.filter(F.transform(pages, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: F.regexp_like(x["p"], F.lit(REFERENCES_HEADING))), lambda x: x["i"] + 1))


def split_references(text: Column) -> Column:
    """(body, references), cut at the last heading."""
    last = F.element_at(F.concat(F.array(F.lit(None).cast("struct<start:int,end:int,match:string>")), spans(text, REFERENCES_HEADING)), -1)
    body = F.when(last.isNull(), text).otherwise(F.substring(text, F.lit(1), last["start"]))
    return F.struct(body.alias("body"), F.when(last.isNull(), F.lit("")).otherwise(F.substring(text, last["end"] + 1, F.length(text))).alias("references"))


def expand_numbers(marks: Column) -> Column:
    """'1, 3-5' -> 1, 3, 4, 5. A range that falls, stands still or spans 100 or more is dropped."""

    def one(chunk: Column) -> Column:
        pair = r"^\s*(\d+)\s*[–\-]\s*(\d+)\s*$"
        a, b = (blank_to_null(F.regexp_extract(chunk, pair, k)).try_cast("int") for k in (1, 2))
        fits = F.coalesce((b - a > 0) & (b - a < 100), F.lit(False))
        single = blank_to_null(F.regexp_extract(chunk, r"^\s*(\d+)\s*$", 1))
        return F.when(fits, F.transform(F.sequence(F.when(fits, a), F.when(fits, b)), lambda i: i.cast("string"))).otherwise(F.array_compact(F.array(single)))

    return F.flatten(F.transform(F.split(marks, r"\s*,\s*"), one))


# ---- numbers ----

NUMBER = r"^([+-]?\d*\.?\d+(?:[eE][+-]?\d+)?)\s*([kKmM]?)$"


def to_number(text: Column) -> Column:
    """A numeric token, with thousands commas, k and M, and exponents; null if it is none."""
    s = F.replace(strip(text), F.lit(","), F.lit(""))
    unit = F.lower(F.regexp_extract(s, NUMBER, 2))
    value = blank_to_null(F.regexp_extract(s, NUMBER, 1)).try_cast("double")
    return value * F.when(unit == "k", 1e3).when(unit == "m", 1e6).otherwise(1.0)


def first_of(match: Column, pattern: str, groups: int) -> Column:
    return F.coalesce(*[blank_to_null(F.regexp_extract(match, pattern, k)) for k in range(1, groups + 1)])


def any_of(words: list[str]) -> str:
    """An alternation of literal words."""
    return "|".join(reduce(lambda w, c: w.replace(c, "\\" + c), ".-+*?()[]{}|", w) for w in words)
