"""Scalar text functions as Column expressions; all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The phrases and patterns that decide the results of the gates.
ANALYTICAL_PHRASES = [
    "explain", "summarize", "summary", "compare", "contrast", "describe", "discuss", "analyze", "analyse", "overview", "outline", "elaborate",
    "walk me through", "tell me about", "give me a", "give an", "provide a", "what are all", "list all", "enumerate", "breakdown", "break down",
    "how does", "how do", "in detail", "comprehensively", "thoroughly", "in depth", "deep dive", "what is the significance", "cover all",
]
OFF_TOPIC_PHRASES = [
    "write a python", "write python", "python function", "python code", "python script", "javascript function", "javascript code", "write a function",
    "write code", "write a program", "write an algorithm", "leetcode", "reverse a linked list", "linked list", "binary search tree", "binary tree",
    "sort an array", "fibonacci sequence", "sql query", "regex for", "regular expression for", "write a regex", "html code", "css code", "for loop",
    "while loop", "write a poem", "write an essay", "write a story", "write a song", "recipe for", "joke about", "tell me a joke", "translate this to",
    "capital of france", "write a sql",
]
REFERENCE_WORDS = "it|its|they|them|their|this|that|these|those|he|she|him|her|his|hers|the same|aforementioned|previous|latter|former"
REFUSAL_MARKERS = {
    "service": ["therefore an answer cannot be generated", "no information relevant", "does not contain information", "cannot answer this based on"],
    "evaluation": ["cannot answer this based on the provided documents", "therefore an answer cannot be generated"],
    "first": ["cannot answer this based on the provided documents", "provided context chunks do not contain", "therefore an answer cannot be generated based on these documents"],
}
INTENT_OF_SYNTHESIZER = {"single_hop_specific_query_synthesizer": "FACT", "multi_hop_abstract_query_synthesizer": "ANALYTICAL", "multi_hop_specific_query_synthesizer": "ANALYTICAL"}
CATEGORY_PATTERNS = [
    ("JOINT VENTURE", "joint_venture"), ("JV AGREEMENT", "joint_venture"), ("JV CONTRACT", "joint_venture"), ("NON-COMPETITION", "non_compete"), ("NON COMPETITION", "non_compete"),
    ("NON SOLICITATION", "non_compete"), ("STRATEGIC ALLIANCE", "strategic_alliance"), ("DEVELOPMENT AGREEMENT", "development"), ("DEVELOPMENT1", "development"), ("DEVELOPMENT2", "development"),
]
DEFAULT_CATEGORY = "development"
SECTION_PATTERN = r"(?m)^((?:ARTICLE|SECTION|SCHEDULE|EXHIBIT|ANNEX|APPENDIX)\s+[\w\d]+.*|(?:Section|Article)\s+\d[\d\.]*\s+\S.*|\d+[\.\d]*\s+[A-Z][A-Z ]{2,50}$)"
#: What stands beside a word, in classes that all engines read alike, unlike their word ends beside letters with accents.
BESIDE = r"[^\p{L}\p{M}\p{N}_]"
FOOTER_PATTERN = r"(?s)(?:\s*\[\d+\])*\s*Sources Used:.*$"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def contains_any(text: Column, phrases: list[str]) -> Column:
    """Whether the lower-cased text holds one of phrases anywhere, inside words too."""
    low = F.lower(text)
    hit = F.lit(False)
    for p in phrases:
        hit = hit | F.contains(low, F.lit(p))
    return hit


def intent(question: Column) -> Column:
    return F.when(contains_any(question, ANALYTICAL_PHRASES), "analytical").otherwise("fact")


def refers_back(question: Column) -> Column:
    """Whether a word asks for what was said before."""
    return question.rlike(rf"(?iu)(?:^|{BESIDE})(?:{REFERENCE_WORDS})(?:$|{BESIDE})")


def normal_space(text: Column, lower: bool = True) -> Column:
    """White space runs as one space, none at the ends; without NULs."""
    out = strip(F.regexp_replace(F.regexp_replace(text, r"\x00", " "), r"\s+", " "))
    return F.lower(out) if lower else out


#: Words in a run.
RUN = 3


def word_runs(text: Column, size: int = RUN) -> Column:
    """Hashes of all runs of size words. The words are bound to a variable: they would be split again for each run."""

    def runs(ws: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(ws) - size, F.lit(0)))
        return F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(ws, i + 1, size), " ")))

    return F.array_distinct(F.get(F.transform(F.array(F.split(text, " ")), runs), F.lit(0)))


def normal_name(name: Column) -> Column:
    """A file name's letters and digits, without the .pdf at its end."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"\.pdf$", ""), "[^a-z0-9]", "")


def fingerprint(text: Column) -> Column:
    return F.sha2(normal_space(text), 256)


def clean_page(text: Column) -> Column:
    """Words parted at line ends joined again; runs of spaces and tabs as one space."""
    return F.regexp_replace(F.regexp_replace(text, r"-\s*\n\s*", ""), r"[ \t]{2,}", " ")


def section_hint(text: Column) -> Column:
    """The first line like a heading within 500 characters, cut to 100; null without one. Lines end in LF, CRLF or CR."""
    lines = F.regexp_replace(F.substring(text, 1, 500), r"\r\n?", "\n")
    return F.nullif(F.substring(strip(F.regexp_extract(lines, "(?d)" + SECTION_PATTERN, 0)), 1, 100), F.lit(""))


def without_footer(text: Column) -> Column:
    """Without the list of sources and all after it."""
    return F.regexp_replace(F.regexp_replace(text, FOOTER_PATTERN, ""), r"\s+$", "")


def category_of(file: Column) -> Column:
    up, out = F.upper(file), None
    for pattern, name in CATEGORY_PATTERNS:
        test = F.contains(up, F.lit(pattern))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(DEFAULT_CATEGORY)


def base_name(path: Column) -> Column:
    """The last part of a path; null where that is no name."""
    name = F.regexp_extract(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)
    return F.when(name.isin("", ".", "..") | F.contains(name, F.lit("\x00")), None).otherwise(name)


def client_ip(forwarded: Column, peer: Column) -> Column:
    """The leftmost forwarded entry, else the peer, else unknown."""
    return F.coalesce(F.nullif(F.trim(F.split_part(forwarded, F.lit(","), F.lit(1))), F.lit("")), peer, F.lit("unknown"))


def rescued_json(raw: Column) -> Column:
    """A JSON object out of a model's text: fences off, else from the first brace to the last; null if neither parses."""
    bare = F.regexp_replace(F.regexp_replace(strip(raw), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    widest = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    ok = lambda c: F.when(F.try_parse_json(c).isNotNull() & F.startswith(c, F.lit("{")), c)
    return F.coalesce(ok(bare), ok(widest))


def preview(text: Column, size: int = 300) -> Column:
    return F.concat(F.substring(text, 1, size), F.lit("..."))


def page_ranges(pages: Column) -> Column:
    """[3, 4, 5, 7] as 'pp. 3-5, 7': neighbours merged, p. for a single page, empty for none."""

    def shown(nums: Column) -> Column:
        starts = F.filter(nums, lambda p: ~F.array_contains(nums, p - 1))
        ends = F.filter(nums, lambda p: ~F.array_contains(nums, p + 1))
        parts = F.zip_with(starts, ends, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat(a.cast("string"), F.lit("-"), b.cast("string"))))
        return F.when(F.size(nums) == 0, "").otherwise(F.concat(F.when(F.size(nums) > 1, "pp. ").otherwise("p. "), F.array_join(parts, ", ")))

    # bound to a variable, so that the pages are sorted once
    return F.get(F.transform(F.array(F.array_sort(F.array_distinct(pages))), shown), F.lit(0))


def quoted_tag(text: Column, tags: list[str], marks: str = '""') -> Column:
    """The first of tags, in their order, that stands in text between marks; null without one."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(marks[0] + t + marks[1])), t) for t in tags])


def tag_within(text: Column, tags: list[str]) -> Column:
    """The first of tags, in their order, that stands anywhere in text in any case; null without one."""
    return F.coalesce(*[F.when(F.contains(F.lower(text), F.lit(t.lower())), t) for t in tags])


def audit_detail(question: Column, files: Column | None = None) -> Column:
    """What an audit row keeps of a question: 200 characters, or of a comparison how many files and 120."""
    if files is None:
        return F.substring(question, 1, 200)
    return F.concat(files.cast("string"), F.lit(" docs · "), F.substring(question, 1, 120))


def intent_of(synthesizer: Column) -> Column:
    low, out = F.lower(synthesizer), None
    for name, intent_ in INTENT_OF_SYNTHESIZER.items():
        out = F.when(low == name, intent_) if out is None else out.when(low == name, intent_)
    return out.otherwise("FACT")


def retry_after(message: Column, default: float = 2.0) -> Column:
    """The seconds that a message asks to wait; default without any."""
    return F.coalesce(F.regexp_extract(message, r"try again in (\d+\.?\d*)s", 1).try_cast("double"), F.lit(default))


def human_size(size: Column) -> Column:
    """Bytes as B, whole KB or MB with one decimal."""
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit("B"))).when(size < 1 << 20, F.concat(F.floor(size / 1024.0 + 0.5).cast("string"), F.lit("KB"))).otherwise(F.format_string("%.1fMB", F.floor(size / 104857.6 + 0.5) / 10))


def first_spelling(claims: Column) -> Column:
    """Claims that differ in more than case and space around them, each as first spelled, in order; blank ones left out."""
    bare = lambda c: F.regexp_replace(c, r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", "")
    shown = F.filter(F.transform(claims, bare), lambda c: c != "")
    keys = F.transform(shown, lambda c: F.lower(c))
    both = F.transform(F.array(F.struct(shown.alias("s"), keys.alias("k"))), lambda x: F.filter(x["s"], lambda c, i: F.array_position(x["k"], F.lower(c)) == i + 1))
    return F.get(both, F.lit(0))
