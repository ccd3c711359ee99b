"""Column builders for text: decimals as written, titles, names, identifiers, terms. All are native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry nothing in a title, or in a claim.
TITLE_STOP = ("a", "an", "and", "for", "from", "in", "of", "on", "the", "to", "with")
TERM_STOP = tuple("""
the and for that this with from are was were has have had not but its
can may our their they these those such than then when where which while
all any been both each into more most other some only also over under
between during within without because however therefore thus been being
use used using shown show shows given give gives well very much many
""".split())
# Parts of names that aren't surnames.
PARTICLES = ("van", "von", "de", "del", "della", "der", "den", "di", "da", "dos", "du", "la", "le", "el", "al", "bin", "ibn", "jr", "sr", "ii", "iii")
# Letters and what they fold to; the rest of the accents are removed one by one.
FOLD_FROM = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
FOLD_TO = "AAAAAACEEEEIIIINOOOOOOUUUUYaaaaaaceeeeiiiinoooooouuuuyy"
# Hyper-parameter names and the form that stands for them.
ALIASES = {
    "lr": "learning_rate", "learningrate": "learning_rate", "learning rate": "learning_rate", "base_lr": "learning_rate", "init_lr": "learning_rate",
    "bs": "batch_size", "batchsize": "batch_size", "batch": "batch_size", "train_batch_size": "batch_size", "per_device_train_batch_size": "batch_size",
    "n_epochs": "epochs", "num_epochs": "epochs", "max_epochs": "epochs", "nepochs": "epochs",
    "wd": "weight_decay", "weightdecay": "weight_decay", "dropout_rate": "dropout", "drop_rate": "dropout",
    "temp": "temperature", "tau": "temperature", "hidden": "hidden_size", "hidden_dim": "hidden_size", "d_model": "hidden_size",
    "n_layers": "num_layers", "nlayers": "num_layers", "depth": "num_layers", "n_heads": "num_heads", "nheads": "num_heads", "attention heads": "num_heads",
    "warmup": "warmup_steps", "warmup_ratio": "warmup_steps", "grad_accum": "gradient_accumulation_steps", "accum_steps": "gradient_accumulation_steps",
    "max_len": "max_length", "seq_len": "max_length", "max_seq_length": "max_length", "lora rank": "lora_rank", "rank": "lora_rank",
}
# Headings and the role of their section, the first role that fits; headings that never have one.
ROLES = {
    "methods": ("method", "materials and methods", "methodology", "experimental setup", "setup", "implementation", "experiment", "procedure", "participants", "data collection", "statistical analysis"),
    "results": ("result", "finding", "evaluation", "analysis", "performance"),
    "discussion": ("discussion", "conclusion", "limitation", "concluding", "implication"),
    "background": ("introduction", "background", "related work", "motivation"),
}
NO_ROLE = ("author contribution", "data availability", "funding", "acknowledg", "ethics", "conflict of interest", "competing interest", "consent", "supplementary", "abbreviation")
# Abbreviations whose point doesn't end a sentence.
ABBREVIATIONS = ("et al.", "e.g.", "i.e.", "cf.", "vs.", "Fig.", "Eq.", "Sec.", "Tab.", "approx.", "resp.", "Dr.", "Prof.", "St.", "No.", "pp.")

MASK, CUT = "\x01", "\x1e"


def decimal_text(x: Column) -> Column:
    """A number as written, with a point for a decimal comma."""
    return F.replace(F.trim(x), F.lit(","), F.lit("."))


def decimals(x: Column) -> Column:
    """Digits after the point, counted from the text: 93.80 has two."""
    t = decimal_text(x)
    return F.when(F.instr(t, ".") > 0, F.length(F.substring_index(t, ".", -1))).otherwise(0)


def fold(x: Column) -> Column:
    x = F.replace(F.replace(F.replace(x, F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae")), F.lit("œ"), F.lit("oe"))
    return F.translate(x, FOLD_FROM, FOLD_TO)


def title_tokens(x: Column) -> Column:
    found = F.regexp_extract_all(F.lower(fold(x)), F.lit("[a-z0-9]+"), 0)
    return F.array_except(found, F.array(*map(F.lit, TITLE_STOP)))


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over that of the union of two arrays of distinct tokens; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def overlap(a: Column, b: Column) -> Column:
    """Size of the intersection over that of the smaller array; 1 if either is empty: nothing speaks against it."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def surname(name: Column) -> Column:
    """The family name of either "Family, Given" or "Given Family"; empty for no name."""
    cleaned = F.trim(fold(F.coalesce(name, F.lit(""))))
    head = F.when(F.instr(cleaned, ",") > 0, F.substring_index(cleaned, ",", 1)).otherwise(cleaned)
    words = F.regexp_extract_all(F.lower(head), F.lit("[a-z][a-z'-]+"), 0)
    own = F.filter(words, lambda w: ~w.isin(*PARTICLES))
    return F.coalesce(F.try_element_at(own, F.lit(-1)), F.try_element_at(words, F.lit(-1)), F.lit(""))


def authors_agree(ours: Column, theirs: Column) -> Column:
    """Whether two arrays of names share a surname; null where either names nobody."""
    a, b = (F.filter(F.transform(F.coalesce(x, F.array().cast("array<string>")), surname), lambda s: s != "") for x in (ours, theirs))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.arrays_overlap(a, b))


def normalize_doi(x: Column) -> Column:
    """Lower-case, without each of the prefixes in turn."""
    out = F.lower(F.trim(x))
    for prefix in ("https://doi.org/", "http://doi.org/", "doi:"):
        out = F.regexp_replace(out, f"^{prefix.replace('.', '[.]')}", "")
    return out


def year_digits(x: Column) -> Column:
    return F.regexp_extract(x, r"[0-9]{4}", 0)


def canonical(name: Column) -> Column:
    """The form that stands for a hyper-parameter: as it is, then flattened, then collapsed; else the flat form."""
    known = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    lowered = F.lower(F.trim(name))
    flat = F.ltrim(F.translate(lowered, "- ", "__"), F.lit("_"))
    collapsed = F.replace(flat, F.lit("_"), F.lit(""))
    return F.coalesce(F.try_element_at(known, lowered), F.try_element_at(known, flat), F.try_element_at(known, collapsed), flat)


def terms(x: Column) -> Column:
    """Distinct content words of three characters or more that begin with a letter, lower-case."""
    found = F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-z][a-z0-9-]{2,}"), 0)
    return F.array_except(F.transform(found, lambda w: F.rtrim(w, F.lit("-"))), F.array(*map(F.lit, TERM_STOP)))


def number_texts(x: Column) -> Column:
    """Distinct numbers of a text but those below 10 and years, so written that 94.20 and 94.2 are the same."""
    raw = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"[0-9]+(?:\.[0-9]+)?"), 0)
    kept = F.filter(raw, lambda t: (t.cast("double") >= 10) & ~t.cast("double").between(1900, 2100))
    trimmed = F.transform(kept, lambda t: F.when(F.instr(t, ".") > 0, F.regexp_replace(t, r"[.]?0+$", "")).otherwise(t))
    return F.array_distinct(F.transform(trimmed, lambda t: F.regexp_replace(t, r"^0+([1-9])", "$1")))


def relatedness(claim: Column, text: Column) -> Column:
    """Share of a claim's terms that a text holds; 1 for a claim without terms."""
    a, b = terms(claim), terms(text)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def fingerprint(rule: Column, message: Column) -> Column:
    """A finding's identity: its rule and the numbers and identifiers of its message; prose doesn't count."""
    salient = F.array_join(F.regexp_extract_all(message, F.lit(r"[0-9]+(?:\.[0-9]+)?|'[^']*'"), 0), " ")
    return F.substring(F.sha2(F.concat(rule, F.lit("|"), salient), 256), 1, 12)


def located(anchors: Column, absent_from: Column) -> Column:
    """Two distinct places at most and how many more there are, then what something is absent from."""
    places = F.array_distinct(anchors)
    shown = F.when(F.size(places) > 2, F.concat(F.slice(places, 1, 2), F.array(F.concat(F.lit("+"), (F.size(places) - 2).cast("string"), F.lit(" more"))))).otherwise(places)
    full = F.when(absent_from.isNotNull(), F.concat(shown, F.array(F.concat(absent_from, F.lit(" (absent)"))))).otherwise(shown)
    return F.array_join(full, " <-> ")


def role_of(heading: Column) -> Column:
    """The role of a section by its heading, numbering left off; empty for apparatus and unknown ones."""
    clean = F.lower(F.trim(F.regexp_replace(F.trim(F.coalesce(heading, F.lit(""))), r"^([0-9]+([.][0-9]+)*|[IVXLC]+|[A-Z])[.)]?\s+", "")))
    never = F.array(*map(F.lit, NO_ROLE))
    out = F.when((clean == "") | F.exists(never, lambda w: F.contains(clean, w)), "")
    for role, words in ROLES.items():
        out = out.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(clean, w)), role)
    return out.otherwise("")


def quantity(x: Column) -> Column:
    """The first number of a sentence, times its k, m or b; null if there is none."""
    pattern = r"([0-9]+(?:\.[0-9]+)?)\s*([kKmMbB](?![A-Za-z]))?"
    scale = F.lower(F.regexp_extract(x, pattern, 2))
    factor = F.when(scale == "k", 1e3).when(scale == "m", 1e6).when(scale == "b", 1e9).otherwise(1.0)
    return F.regexp_extract(x, pattern, 1).try_cast("double") * factor


def margin(ours: Column, baseline: Column) -> Column:
    """Gain over a baseline in proportion to it; null for a baseline of 0."""
    return F.when(baseline != 0, (ours - baseline) / F.abs(baseline))


def arxiv_id(*fields: Column) -> Column:
    found = [F.nullif(F.regexp_extract(f, r"([0-9]{4}[.][0-9]{4,5})(v[0-9]+)?", 1), F.lit("")) for f in fields]
    return F.coalesce(*found)


def arxiv_id_of(fields: Column, known: Column | None = None) -> Column:
    """The arXiv id of a bibliography entry (a map of its fields): what a record says, then its eprint, then any field that speaks of arXiv. Ids of both kinds."""
    new, old = r"\b([0-9]{4}[.][0-9]{4,5})(?:v[0-9]+)?\b", r"\b([a-z][a-z-]{2,}(?:[.][A-Z]{2})?/[0-9]{7})(?:v[0-9]+)?\b"
    of = lambda x: F.coalesce(*[F.nullif(F.regexp_extract(x, rx, 1), F.lit("")) for rx in (new, old)])
    get = lambda k: F.coalesce(F.try_element_at(fields, F.lit(k)), F.lit(""))
    archive = F.lower(get("archiveprefix"))
    own = F.when((archive == "") | F.contains(archive, F.lit("arxiv")), of(get("eprint")))
    named = [F.when(F.contains(F.lower(get(k)), F.lit("arxiv")), of(get(k))) for k in ("url", "journal", "note", "howpublished", "doi")]
    return F.coalesce(F.nullif(known, F.lit("")) if known is not None else F.lit(None).cast("string"), own, *named, F.lit(""))


def pmcid_of(fields: Column, known: Column | None = None) -> Column:
    """The PMCID of a bibliography entry: what a record says, then the first field that holds one."""
    get = lambda k: F.coalesce(F.try_element_at(fields, F.lit(k)), F.lit(""))
    found = [F.nullif(F.upper(F.regexp_extract(get(k), r"(?i)\b(PMC[0-9]{4,})\b", 1)), F.lit("")) for k in ("pmcid", "url", "note", "eprint")]
    return F.coalesce(F.nullif(known, F.lit("")) if known is not None else F.lit(None).cast("string"), *found, F.lit(""))


def reason_code(message: Column) -> Column:
    """Why an input couldn't be read, by what its message says."""
    m = F.lower(message)
    out = F.when(F.contains(m, F.lit("pdf")), "pdf")
    for needle, code in (("binary", "binary"), ("ratio", "bomb"), ("unpack", "too-large"), ("members", "too-many"), ("no .tex", "no-source"), ("not found", "missing"), ("empty", "empty")):
        out = out.when(F.contains(m, F.lit(needle)), code)
    return out.otherwise("other")


def masked_sentences(x: Column) -> Column:
    """The sentences of a text, each with the white space after it, so their lengths add up to the text's.
    A sentence ends at . ! or ?, white space, and a capital or an opening bracket; points of abbreviations don't count."""
    for a in ABBREVIATIONS:
        x = F.replace(x, F.lit(a), F.lit(a.replace(".", MASK)))
    cut = F.regexp_replace(x, r"([.!?])([ \t\r\n]+)([A-Z(\[])", rf"$1$2{CUT}$3")
    return F.transform(F.split(cut, CUT), lambda s: F.replace(s, F.lit(MASK), F.lit(".")))
