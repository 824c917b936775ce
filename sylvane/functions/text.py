"""Text expressions: normalising, chunking, searching, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sylvane.functions.binding import let

# The steps of normalisation, pattern and replacement, in order.
NORMALISE = (
    (r"[^\x20-\x7E\n\t]", ""),
    (r"[ \n\t]+", " "),
)
NORMALISE_TRIMMED = (
    (r"\S{15,}", ""),
    (r"--+", ""),
    (r"cut\s+here[.]+end\s+cut\s+here", ""),
)

# Accents that PDF extraction leaves apart, and the letters they make, in order.
ACCENTS = (
    ("˜a", "ã"), ("˜A", "Ã"), ("˜e", "ẽ"), ("˜E", "Ẽ"), ("˜i", "ĩ"), ("˜I", "Ĩ"), ("˜o", "õ"), ("˜O", "Õ"), ("˜u", "ũ"), ("˜U", "Ũ"),
    ("c¸", "ç"), ("C¸", "Ç"),
    ("´a", "á"), ("´A", "Á"), ("´e", "é"), ("´E", "É"), ("´i", "í"), ("´I", "Í"), ("´o", "ó"), ("´O", "Ó"), ("´u", "ú"), ("´U", "Ú"),
    ("ˆa", "â"), ("ˆA", "Â"), ("ˆe", "ê"), ("ˆE", "Ê"), ("ˆo", "ô"), ("ˆO", "Ô"),
    ("`a", "à"), ("`A", "À"),
    ("´ı", "í"),
)

# The words that topic diversity leaves out.
STOP_WORDS = (
    "the", "is", "at", "which", "on", "a", "an", "and", "or", "but", "in", "with", "to", "for", "of", "as", "by", "it", "this", "that",
    "are", "was", "were", "been", "be", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might",
)


def normalise(text: Column) -> Column:
    """Printable ASCII on one line; runs of 15 and more characters, dashes and cut marks go."""
    for pattern, to in NORMALISE:
        text = F.regexp_replace(text, pattern, to)
    text = F.trim(text)
    for pattern, to in NORMALISE_TRIMMED:
        text = F.regexp_replace(text, pattern, to)
    return text


def filtered_words(normal: Column) -> Column:
    """Words of letters and digits only, shorter than ten characters."""
    return F.filter(F.split(normal, " "), lambda w: w.rlike("^[a-zA-Z0-9]+$") & (F.length(w) < 10))


def windows(words: Column, size: int, overlap: int) -> Column:
    """Sliding windows of an array that step by ``size - overlap``; the last one may be shorter."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than the size")
    step = size - overlap
    count = F.ceil((F.size(words) - size) / F.lit(step)).cast("int")
    many = F.transform(F.sequence(F.lit(0), count), lambda i: F.slice(words, i * step + 1, F.lit(size)))
    return F.when(F.size(words) <= size, F.array(words)).otherwise(many)


def chunks(normal: Column, words: Column, size: int = 350, overlap: int = 50, max_characters: int = 1000) -> Column:
    """Chunks of a text: itself if it has no more than ``size`` filtered words, else windows of those words."""
    cut = lambda c: F.substring(c, 1, max_characters)
    many = F.transform(windows(words, size, overlap), lambda w: cut(F.array_join(w, " ")))
    return F.when(F.size(words) <= size, F.array(cut(normal))).otherwise(many)


def words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def crop_words(text: Column, most: int) -> Column:
    """The text itself if it has no more words, else the first ones joined by single spaces."""
    w = words(text)
    return F.when(F.size(w) <= most, text).otherwise(F.array_join(F.slice(w, 1, most), " "))


def repair_accents(text: Column) -> Column:
    """Accents put back on their letters, pair by pair."""
    for apart, whole in ACCENTS:
        text = F.replace(text, F.lit(apart), F.lit(whole))
    return text


def first_match(text: Column, pattern: str) -> Column:
    """The first match of a pattern, which may be empty; null without one."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 0))


def ngrams_up_to(tokens: Column, n: int) -> Column:
    """Distinct n-grams of 1 to ``n`` tokens, joined by spaces."""

    def grams(words: Column, k: int) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.array_join(F.slice(words, i + 1, F.lit(k)), " "))
        return F.when(F.size(words) >= k, made).otherwise(F.array().cast("array<string>"))

    return let(tokens, lambda words: F.array_distinct(F.concat(*[grams(words, k) for k in range(1, n + 1)])))


def top_words(text: Column, k: int = 10, least_length: int = 3, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """The first ``k`` words in lower case that are long enough and no stop words, repeats included."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"\b\w+\b"), F.lit(0))
    return F.slice(F.filter(found, lambda w: ~w.isin(*stop_words) & (F.length(w) >= least_length)), 1, k)


def short_label(question: Column, most: int = 60) -> Column:
    """At most ``most`` characters, the end of a longer one as three dots."""
    return F.when(F.length(question) > most, F.concat(F.substring(question, 1, most - 3), F.lit("..."))).otherwise(question)


def category(*columns: Column) -> Column:
    """One key of several values, as text joined by underscores."""
    return F.concat_ws("_", *[c.cast("string") for c in columns])


def run_parameters(path: Column) -> Column:
    """(dataset, llm, selection, nli): the last four parts of a result file's name."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.json$", "")
    part = lambda i: F.try_element_at(F.split(stem, "_"), F.lit(i))
    return F.struct(part(-4).alias("dataset"), part(-3).alias("llm"), part(-2).alias("selection"), part(-1).alias("nli"))


def first_contained(text: Column, cases: tuple[tuple[str, str], ...], default: str = "unknown") -> Column:
    """The name of the first case whose key the text contains."""
    found = F.lit(default)
    for key, name in reversed(cases):
        found = F.when(text.contains(key), F.lit(name)).otherwise(found)
    return found


def path_text(decisions: Column) -> Column:
    """One line for each decision of a path: the question and Yes or No."""
    line = lambda d: F.concat(F.lit("Question: "), d["hypothesis"], F.lit("? Answer: "), F.when(d["decision"] == "yes", "Yes").otherwise("No"))
    return F.array_join(F.transform(decisions, line), "\n")


def path_maps(decisions: Column) -> Column:
    """A path as an array of one-entry maps, hypothesis to decision."""
    return F.transform(decisions, lambda d: F.create_map(d["hypothesis"], d["decision"]))


def maps_path(maps: Column) -> Column:
    """The path of an array of one-entry maps."""
    entry = lambda m: F.get(F.map_entries(m), F.lit(0))
    return F.transform(maps, lambda m: F.struct(entry(m)["key"].alias("hypothesis"), entry(m)["value"].alias("decision")))


def equal_levels(a: Column, b: Column) -> Column:
    """Levels that two paths share from the root; 0 where their lengths differ."""
    same = F.zip_with(a, b, lambda x, y: x == y)
    prefix = F.coalesce(F.array_position(F.transform(same, lambda s: s.cast("int")), 0), F.lit(0))
    return F.when(F.size(a) != F.size(b), 0).when(prefix == 0, F.size(a)).otherwise(prefix - 1).cast("int")


def prompt(texts: Column, avoid: Column | None = None, most_words: int = 350) -> Column:
    """The prompt of a collection, with the topics to avoid if there are any."""
    made = F.concat(F.lit("Texts: ["), F.array_join(F.transform(texts, lambda t: crop_words(t, most_words)), ", "), F.lit("]"))
    return made if avoid is None else F.concat(made, _avoid(avoid))


def split_prompt(a: Column, b: Column, avoid: Column | None = None, most_words: int = 350) -> Column:
    """The prompt of two collections that are to be told apart."""
    side = lambda name, t: F.concat(F.lit(f"Collection {name}: ["), F.array_join(F.transform(t, lambda x: crop_words(x, most_words)), ", "), F.lit("]"))
    made = F.concat(side("A", a), F.lit("\n\n"), side("B", b))
    return made if avoid is None else F.concat(made, _avoid(avoid))


def _avoid(topics: Column) -> Column:
    return F.when(F.size(topics) > 0, F.concat(F.lit("\nAvoid the following topics: ["), F.array_join(topics, ", "), F.lit("]\n"))).otherwise("")
