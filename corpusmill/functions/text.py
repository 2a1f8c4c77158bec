"""Column functions over text. All stay inside the JVM; patterns keep to the common subset of Java and RE2."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Word lists and weights that results depend on.
STOP_WORDS = ["the", "is", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for"]
SQL_STEMS = ["select", "from", "where", "join", "group", "order", "by"]
SQL_KEYWORDS = [
    "sql", "select", "join", "where", "table", "column", "view", "query", "database", "schema", "procedure", "function",
    "aggregate", "count", "sum", "group by", "order by", "union", "cte", "with", "insert", "update", "delete",
    "create", "alter", "drop", "index", "constraint", "dbt", "model", "macro", "jinja", "ref()", "source()",
]
CODE_PATTERNS = [r"ERR(?:OR)?[-_]?\d{3,6}", r"(?:TICKET|ISSUE|JIRA)[-_]?\d{3,6}", r"v?\d+\.\d+\.\d+", r"(?:REF|DOC)[-_]?\d{3,6}"]
LANGUAGES = {"py": "python", "sql": "sql", "yaml": "yaml", "yml": "yaml", "json": "json", "md": "markdown", "txt": "text", "cs": "csharp", "java": "java"}


def normalise_query(c: Column) -> Column:
    """Trimmed, lower-cased, white space collapsed, at most 1000 characters."""
    return F.substring(F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))), 1, 1000)


def valid_query(c: Column) -> Column:
    return F.length(normalise_query(c)) >= 3


def strip_special(c: Column) -> Column:
    """The stricter normal form: letters, digits and blanks only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "), r"\s+", " "))


def tokens(c: Column) -> Column:
    """Lower-cased words between runs of white space."""
    return F.array_remove(F.split(F.lower(c), r"\s+"), "")


def first_words(low: Column, n: int) -> Column:
    """The first ``n`` words of a lower-cased text; what lies behind them isn't split. Only the first piece can be empty before that."""
    return F.slice(F.array_remove(F.slice(F.split(low, r"\s+", n + 2), 1, n + 1), ""), 1, n)


def contains_any(c: Column, terms: Sequence[str]) -> Column:
    """Whether any term occurs as a substring."""
    found = F.lit(False)
    for t in terms:
        found = found | F.contains(c, F.lit(t))
    return found


def count_terms(c: Column, terms: Sequence[str]) -> Column:
    """How many of the terms occur as substrings."""
    total = F.lit(0)
    for t in terms:
        total = total + F.contains(c, F.lit(t)).cast("int")
    return total


def occurrences(c: Column, term: str) -> Column:
    """Non-overlapping occurrences of a term."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(term), F.lit("")))) / len(term)).cast("int")


def is_sql_related(c: Column) -> Column:
    return contains_any(F.lower(c), SQL_KEYWORDS)


def query_terms(query: str) -> list[str]:
    """Words, parts of compound identifiers and quoted strings of one query, without stop words."""
    import re

    words = query.lower().split()
    found = [*words, *(p.lower() for p in re.findall(r"[A-Z][a-z]+|[a-z]+", query))]
    found += [p for w in words if "_" in w for p in w.split("_")]
    found += [q.lower() for q in re.findall(r"[\"']([^\"'\n]+)[\"']", query)]
    return sorted({t for t in found if t not in STOP_WORDS or t in SQL_STEMS})


def phrases(query: str) -> list[tuple[str, float]]:
    """What an exact match of a query looks for: runs of two to four words, identifiers, calls; with weights."""
    import re

    low = query.lower()
    words = low.split()
    found = [(" ".join(words[i : i + n]), 0.3) for n in (2, 3, 4) for i in range(len(words) - n + 1)]
    found += [(x, 0.4) for x in re.findall(r"\b[a-z_]+_[a-z_]+\b", low)]
    return found + [(x, 0.5) for x in re.findall(r"\b[a-z_]+\(\)", low)]


def exact_match_boost(text: Column, query: str) -> Column:
    total = F.lit(0.0)
    low = F.lower(text)
    for phrase, weight in phrases(query):
        total = total + F.when(F.contains(low, F.lit(phrase)), weight).otherwise(0.0)
    return F.least(total, F.lit(1.0))


def strip_tags(c: Column) -> Column:
    """Tags to blanks, white space collapsed, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+", " "))


def html_text(c: Column) -> Column:
    """Visible text: scripts and styles dropped, lines trimmed, split at double blanks, blank ones dropped."""
    body = F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>", "")
    body = F.regexp_replace(body, r"(?is)<style[^>]*>.*?</style>", "")
    body = F.regexp_replace(body, r"<[^>]+>", "")
    lines = F.flatten(F.transform(F.split(body, "\n"), lambda x: F.split(F.trim(x), "  ")))
    return F.array_join(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""), "\n")


def domain_codes(c: Column) -> Column:
    """Distinct error, ticket, version and reference codes in order of their patterns."""
    every = F.concat(*(F.regexp_extract_all(c, F.lit(f"(?i){p}"), F.lit(0)) for p in CODE_PATTERNS))
    return F.array_distinct(every)


def sentences(c: Column) -> Column:
    one_line = F.trim(F.regexp_replace(F.replace(c, F.lit("\n"), F.lit(" ")), r"\s+", " "))
    return F.filter(F.transform(F.split(one_line, r"[.!?]+"), lambda x: F.trim(x)), lambda x: x != "")


def line_count(c: Column) -> Column:
    return F.size(F.split(c, "\n"))


def language_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    names = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.coalesce(F.get(F.transform(F.array(ext), lambda e: names[e]), F.lit(0)), F.lit("code"))


def document_key(source: Column, text: Column) -> Column:
    """Source and the first eight hex digits of the md5 of the first hundred characters."""
    return F.concat_ws("_", F.coalesce(F.when(source == "", None).otherwise(source), F.lit("unknown")), F.substring(F.md5(F.substring(text, 1, 100)), 1, 8))


def preview(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def last_dotted(c: Column) -> Column:
    return F.element_at(F.split(c, r"\."), -1)


def file_kind(path: Column) -> Column:
    """What the summariser calls a file, by suffix."""
    low = F.lower(path)
    out = F.lit("generic")
    for kind, ends in (("markdown", [".md", ".markdown"]), ("pdf", [".pdf"]), ("yaml", [".yaml", ".yml"]), ("python", [".py"]), ("sql", [".sql"])):
        cond = F.lit(False)
        for e in ends:
            cond = cond | F.endswith(low, F.lit(e))
        out = F.when(cond, kind).otherwise(out)
    return out


def split_context(c: Column) -> Column:
    """Documents of a context string, split at the first separator of the list that occurs."""
    out = F.array(c)
    for sep in reversed(["---", "Document:", "Source:", "===", "###"]):
        parts = F.filter(F.transform(F.split(c, sep), lambda x: F.trim(x, F.lit(" \t\n\x0b\f\r"))), lambda x: x != "")
        out = F.when(F.contains(c, F.lit(sep)), F.when(F.size(parts) > 0, parts).otherwise(F.array(c))).otherwise(out)
    return out


def commit_summary(commits: Column) -> Column:
    """A heading and a line for each commit struct (date, short_id, author, message): the day, the short id, the
    first line of the message cut at 80 characters, and the author; a note where there are no commits."""
    or_ = lambda c, other: F.coalesce(c, F.lit(other))
    first = lambda m: F.split_part(or_(m, "No message"), F.lit("\n"), F.lit(1))
    day = lambda x: F.split_part(or_(x["date"], "unknown"), F.lit("T"), F.lit(1))
    short = lambda m: F.when(F.length(first(m)) > 80, F.concat(F.substring(first(m), 1, 77), F.lit("..."))).otherwise(first(m))
    line = lambda x: F.concat(F.lit("- ["), day(x), F.lit("] "), or_(x["short_id"], "???????"), F.lit(" - "), short(x["message"]), F.lit(" (by "), or_(x["author"], "Unknown"), F.lit(")"))
    lines = F.array_join(F.concat(F.array(F.lit("Recent commit history:")), F.transform(commits, line)), "\n")
    return F.when(F.coalesce(F.size(commits), F.lit(0)) > 0, lines).otherwise("No commit history available")


def variations_from_text(c: Column, least: int = 10) -> Column:
    """Numbered, bulleted or quoted lines of a model's answer, without their marks."""
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: F.rlike(x, F.lit(r"^([0-9]+[.)]|[-*•]|\")")))
    bare = F.transform(lines, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^([0-9]+[.)]|[-*•])\s*", ""), r"^\"|\"$", "")))
    return F.array_distinct(F.filter(bare, lambda x: F.length(x) > least))


EXPANSION = "variations array<string>, project string, confidence double"
SUMMARY = "summary string, keywords array<string>, topics array<string>, business_context string, technical_details map<string,string>"


def expansion_answer(c: Column) -> Column:
    """A model's expansion answer as a struct (variations, project, confidence).

    The inside of a fence is parsed as JSON, what is missing beside the variations gets a default, and an
    answer that isn't JSON is read as lines (``variations_from_text``); null if it has no variations at all.
    """
    data = F.from_json(strip_fence(c), EXPANSION)
    parsed = F.get_json_object(strip_fence(c), "$").isNotNull()
    from_lines = variations_from_text(c)
    made = lambda v, p, n: F.struct(v.alias("variations"), p.alias("project"), n.alias("confidence"))
    good = made(data["variations"], F.coalesce(data["project"], F.lit("general")), F.coalesce(data["confidence"], F.lit(0.5)))
    plain = made(from_lines, F.lit("general"), F.lit(0.5))
    return F.when(parsed & data["variations"].isNotNull(), good).when(~parsed & (F.size(from_lines) > 0), plain)


def summary_answer(c: Column) -> Column:
    """A model's summary answer as a struct; null where it isn't JSON with a summary."""
    data = F.from_json(strip_fence(c), SUMMARY)
    return F.when(data["summary"].isNotNull(), data)


def summary_text(filename: Column, kind: Column, answer: Column) -> Column:
    """The text of a summary that is embedded: file and type, then what the answer has, under headings."""
    some = lambda x: F.coalesce(x, F.lit("")) != ""
    block = lambda name, x: F.when(some(x), F.concat(F.lit(f"{name}:\n"), x, F.lit("\n")))
    listed = lambda name, x: F.when(F.coalesce(F.size(x), F.lit(0)) > 0, F.concat(F.lit(f"{name}: "), F.array_join(x, ", ")))
    head = F.concat(F.lit("Document: "), F.coalesce(filename, F.lit("Unknown")), F.lit("\nType: "), F.coalesce(kind, F.lit("Unknown")), F.lit("\n"))
    parts = F.array(head, block("Summary", answer["summary"]), block("Business Context", answer["business_context"]), listed("Keywords", answer["keywords"]), listed("Topics", answer["topics"]))
    return F.array_join(F.array_compact(parts), "\n")


def flat_details(details: Column) -> Column:
    """Details of JSON texts as plain strings under ``tech_`` names: lists joined, objects left out."""
    kept = F.map_filter(details, lambda _, v: ~F.startswith(F.ltrim(F.coalesce(v, F.lit(""))), F.lit("{")))
    plain = F.transform_values(kept, lambda _, v: F.when(F.startswith(v, F.lit("[")), F.array_join(F.from_json(v, "array<string>"), ", ")).otherwise(v))
    return F.transform_keys(plain, lambda k, _: F.concat(F.lit("tech_"), k))


def fallback_variations(c: Column, most: int = 9) -> Column:
    """What stands in for a model's variations: templates around the query, distinct, without the query itself."""
    forms = [c, F.concat(F.lit("What is "), c, F.lit("?")), F.concat(F.lit("Explain "), c), F.concat(F.lit("Define "), c)]
    forms += [F.replace(c, F.lit(a), F.lit(b)) for a, b in (("?", ""), ("how", "what"), ("is", "are"))] + [F.lower(c), F.lower(F.upper(c))]
    every = F.array_distinct(F.array(*forms))
    return F.slice(every, F.lit(2), F.greatest(F.least(F.size(every), F.lit(most)) - 1, F.lit(0)))


def cache_key(c: Column) -> Column:
    return F.md5(F.trim(F.lower(c), F.lit(" \t\n\x0b\f\r")))


def chunk_identity(chunk_id: Column, other: Column, text: Column) -> Column:
    """The first that is there: the chunk's id, another id, the md5 of the text."""
    return F.coalesce(chunk_id, other, F.md5(text))


def citation(path: Column, start: Column, end: Column) -> Column:
    return F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def web_url(base: Column, repository: Column, path: Column, branch: Column) -> Column:
    """Where a file of a repository can be seen, on a branch by its short name."""
    return F.concat(base, F.lit("/_git/"), repository, F.lit("?path="), path, F.lit("&version=GB"), F.replace(branch, F.lit("refs/heads/"), F.lit("")))


def daily_file(at: Column) -> Column:
    """Name of the log of a time's day."""
    return F.concat(F.date_format(at.cast("timestamp"), "yyyy-MM-dd"), F.lit(".jsonl"))


def percentage(share: Column, digits: int = 0) -> Column:
    """With so many digits, halves to the even one."""
    return F.format_string(f"%.{digits}f%%", F.bround(share.cast("double"), digits))


def strip_fence(c: Column) -> Column:
    """The inside of a fenced block, for parsing as JSON."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[a-z]*\n", ""), r"\n?```$", ""))


def path_context(path: Column) -> Column:
    """What a path tells about its file: layers by name, then its first folders."""
    low = F.lower(path)
    tag = lambda words, name: F.when(contains_any(low, words), name)
    tags = [tag(["dbt"], "dbt project"), tag(["staging", "stg_"], "staging layer"), tag(["models"], "data models"), tag(["fact", "dim"], "dimensional model")]
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", ".", ".."))
    first = F.when(F.startswith(path, F.lit("/")), F.slice(parts, 1, 2)).otherwise(F.slice(parts, 1, 3))
    every = F.concat(F.array_compact(F.array(*tags)), first)
    return F.when(F.coalesce(path, F.lit("")) == "", "unknown context").when(F.size(every) > 0, F.array_join(every, ", ")).otherwise("project file")
