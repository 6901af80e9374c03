"""Scalar functions on strings, numbers, dates and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Technology labels to assay names.
ASSAYS = {
    "3_prime_gex": "10x 3' transcription profiling",
    "5_prime_gex": "10x 5' transcription profiling",
    "flex": "10x gene expression flex",
    "vdj": "10x immune profiling",
}
# Common to latin species names. Names are looked up with
# underscores for spaces, so those of two words stay as they are.
SPECIES = {
    "human": "homo_sapiens",
    "mouse": "mus_musculus",
    "green monkey": "chlorocebus_sabaeus",
    "rat": "rattus_norvegicus",
    "chimpanzee": "pan_troglodytes",
    "bonobo": "pan_paniscus",
    "macaque": "macaca_mulatta",
    "crab-eating macaque": "macaca_fascicularis",
    "gorilla": "gorilla_gorilla",
    "chicken": "gallus_gallus",
    "marmoset": "callithrix_jacchus",
}
# Tags that count as a whole, and beginnings of others.
EXACT_TAGS = ("stable", "fp32", "esm2", "dnaseq", "shuffleall", "resume", "from_scratch")
TAG_STARTS = ("lr", "epoch", "huber", "clip", "lossw")
MODEL_SIZES = ("100m", "500m", "1b")


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def lower_underscore(c: Column) -> Column:
    """Trimmed, lower case, spaces to underscores; null stays."""
    return F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("_"))


def assay_name(c: Column, names: dict[str, str] | None = None) -> Column:
    return F.coalesce(F.try_element_at(_map(names or ASSAYS), c), F.lit("unknown"))


def gene_key(c: Column) -> Column:
    """Identifier without its version suffix."""
    return F.substring_index(F.lower(F.trim(c)), ".", 1)


def latin_species(c: Column, names: dict[str, str] | None = None) -> Column:
    own = lower_underscore(c)
    return F.coalesce(F.try_element_at(_map(names or SPECIES), own), own)


def disease_label(c: Column) -> Column:
    own = F.lower(F.trim(c))
    return F.when(own == "health", F.lit("normal")).otherwise(own)


def barcode(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "-1$", "")


def strict_int(c: Column, tolerance: float = 1e-6) -> Column:
    """Integer within ``tolerance`` of the number that the text shows, else null."""
    x = c.try_cast("double")
    return F.when(F.abs(x - F.rint(x)) <= tolerance, F.rint(x).try_cast("bigint"))


def lenient_int(c: Column) -> Column:
    """Rounded half to even; null where there is no finite number."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), F.rint(x)).try_cast("bigint")


def lax_number(*cols: Column) -> Column:
    """First of several texts that is a number; NaN counts as none."""
    each = [F.when(~F.isnan(c.try_cast("double")), c.try_cast("double")) for c in cols]
    return F.coalesce(*each)


def step_number(*cols: Column) -> Column:
    """As a whole step, cut towards zero."""
    return lax_number(*cols).try_cast("bigint")


def name_time(c: Column) -> Column:
    """ISO time of a name's trailing ``YYYYMMDD_HHMMSS``; null without one or
    with digits that are no time."""
    stamp = F.regexp_extract(c, r"(\d{8}_\d{6})$", 1)
    return F.date_format(F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("yyyyMMdd_HHmmss")), "yyyy-MM-dd'T'HH:mm:ss")


def _body(c: Column) -> Column:
    """A run name without prefix and time."""
    rest = F.regexp_replace(F.regexp_replace(c, r"^training_output_", ""), r"\d{8}_\d{6}$", "")
    return F.regexp_replace(rest, "^_+|_+$", "")


def model_size(c: Column) -> Column:
    """First of the known sizes that stands as a part of the name."""
    found = [F.when(_body(c).rlike(f"(^|_){s}(_|$)"), F.lit(s)) for s in MODEL_SIZES]
    return F.coalesce(*found, F.lit("unknown"))


def data_recipe(c: Column) -> Column:
    return F.regexp_extract(_body(c), r"data(?:_\d+)+", 0)


def experiment_name(c: Column) -> Column:
    """What is left of a name without size and recipe."""
    size, recipe = model_size(c), data_recipe(c)
    rest = F.regexp_replace(F.concat(F.lit("_"), _body(c), F.lit("_")), F.concat(F.lit("^(.*?)_"), size, F.lit("_(.*)$")), F.lit("$1_$2"))
    at = F.instr(rest, recipe)
    cut = F.when(F.length(recipe) > 0, F.concat(F.substring(rest, F.lit(1), at - 1), F.substring(rest, at + F.length(recipe), F.length(rest)))).otherwise(rest)
    return F.regexp_replace(F.regexp_replace(cut, "_+", "_"), "^_|_$", "")


def name_tokens(c: Column) -> Column:
    """Parts of a run name in order, each once."""
    return F.array_distinct(F.filter(F.split(_body(c), "_"), lambda x: x != ""))


def name_tags(c: Column) -> Column:
    """Tags of a run name in order, each once."""
    parts = F.filter(F.split(_body(c), "_"), lambda x: x != "")

    def of(token: Column, i: Column) -> Column:
        after = F.get(parts, i + 1)
        return F.array_compact(
            F.array(
                F.when(token.isin(*EXACT_TAGS), token),
                F.when((token == "from") & (after == "scratch"), F.lit("from_scratch")),
                F.when((token == "lossw") & after.isNotNull(), F.concat(F.lit("lossw_"), after)),
                F.when(token.rlike("^(" + "|".join(TAG_STARTS) + ")"), token),
            )
        )

    return F.array_distinct(F.flatten(F.transform(parts, of)))


def readable_number(token: Column) -> Column:
    """``lr5em4`` to ``5e-4``, ``clip0p5`` to ``0.5``: the number that a token writes."""
    raw = F.regexp_extract(token, r"^[a-z]+(\d[0-9a-z.\-]*)$", 1)
    shown = F.regexp_replace(F.regexp_replace(raw, r"(\d)em(\d)", "$1e-$2"), r"(\d)p(\d)", "$1.$2")
    return F.nullif(shown, F.lit(""))


def keywords(c: Column, stop: tuple[str, ...] = ("the", "and", "for", "with", "of"), least: int = 2) -> Column:
    parts = F.split(F.lower(c), r"[^a-z0-9_.\-]+")
    return F.array_distinct(F.filter(parts, lambda x: (F.length(x) >= least) & ~x.isin(*stop)))


def shorten(c: Column, width: int = 220) -> Column:
    """Whitespace collapsed; longer texts end in an ellipsis within the width."""
    flat = F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))
    return F.when(F.length(flat) > width, F.concat(F.rtrim(F.substring(flat, 1, width - 3)), F.lit("..."))).otherwise(flat)


def snippet(c: Column, width: int = 8000) -> Column:
    return F.struct(F.substring(c, 1, width).alias("text"), (F.length(c) > width).alias("truncated"))


def heading(markdown: Column) -> Column:
    """Text of the first heading."""
    rows = F.filter(F.split(markdown, "\n"), lambda x: x.rlike(r"^#+ "))
    return F.regexp_replace(F.get(rows, F.lit(0)), r"^#+ +", "")


def first_plain_line(markdown: Column, width: int = 240) -> Column:
    rows = F.filter(F.split(markdown, "\n"), lambda x: (F.trim(x) != "") & ~x.rlike(r"^#"))
    return F.substring(F.trim(F.get(rows, F.lit(0))), 1, width)


def plain_markdown(c: Column) -> Column:
    out = F.regexp_replace(c, r"\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"[`*]+", "")
    out = F.regexp_replace(out, r"(^|\n)[>#]+ *", "$1")
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def redact(c: Column, names: str = "token|secret|password|key") -> Column:
    return F.regexp_replace(c, rf"(?i)\b(\w*(?:{names})\w*)=\S+", "$1=<redacted>")


def blank_off(c: Column) -> Column:
    """Empty for values that mean off."""
    return F.when(F.lower(F.trim(c)).isin("", "0", "0.0", "false"), F.lit("")).otherwise(F.trim(c))


def size_bytes(c: Column) -> Column:
    """Bytes of texts as ``1.5 GB``, ``10KiB``; null where it is no size."""
    number = F.regexp_extract(F.lower(c), r"^\s*(\d+(?:\.\d+)?)\s*([kmgt]?)i?b?\s*$", 1)
    unit = F.regexp_extract(F.lower(c), r"^\s*(\d+(?:\.\d+)?)\s*([kmgt]?)i?b?\s*$", 2)
    power = F.when(unit == "k", 1).when(unit == "m", 2).when(unit == "g", 3).when(unit == "t", 4).otherwise(0)
    return (F.nullif(number, F.lit("")).cast("double") * F.pow(F.lit(1024.0), power)).cast("bigint")


def readable_bytes(c: Column, largest: str = "TiB") -> Column:
    """Whole bytes in binary units up to ``largest``, with two decimals from 1 KiB on:
    exact, ties to the even hundredth."""
    c = c.cast("bigint")
    units = ["KiB", "MiB", "GiB", "TiB"]
    units = units[: units.index(largest) + 1]
    out = F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B")))
    for k, unit in enumerate(units, 1):
        size = 1024**k
        over = (c % size) * 100
        cents = F.floor(over / size)  # over is below 2**47, so that the quotient is exact
        left = (over % size) * 2
        up = (left > size) | ((left == size) & (cents % 2 == 1))
        cents = F.floor((c - c % size) / size) * 100 + cents + up.cast("bigint")
        text = F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(f" {unit}"))
        out = out.when(c < size * 1024, text) if unit != largest else out.otherwise(text)
    return out


def learning_rate(i: Column, peak: float, warm: int, total: int, floor: float) -> Column:
    """Linear warm-up, cosine decay, then the floor."""
    ratio = (i - warm) / F.lit(float(max(total - warm, 1)))
    decayed = floor + 0.5 * (1 + F.cos(F.lit(3.141592653589793) * ratio)) * (peak - floor)
    return F.when(i < warm, peak * (i + 1) / (warm + 1)).when(i > total, F.lit(floor)).otherwise(decayed)


def short_hash(*cols: Column, sep: str = "|", length: int = 16) -> Column:
    return F.substring(F.sha1(F.concat_ws(sep, *cols)), 1, length)


def unit_key(seed: int | Column, *ids: Column) -> Column:
    """A uniform 52-bit whole number from a seed and row ids, alike in any engine."""
    seed = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    return F.conv(F.substring(F.md5(F.concat_ws(":", seed, *[c.cast("string") for c in ids])), 1, 13), 16, 10).cast("bigint")


UNIT = 1 << 52


def confidence(changes: Column, strong: Column) -> Column:
    return F.when((changes >= 2) & strong, F.lit("high")).when(changes >= 1, F.lit("medium")).otherwise(F.lit("low"))


def run_settings(text: Column) -> dict[str, Column]:
    """Settings that a run's name or tags spell out, as values; empty: not said."""
    got = lambda p, i=1: F.regexp_extract(text, p, i)
    two = lambda p, by: F.when(text.rlike(p), F.concat(got(p), F.lit(by), got(p, 2)))
    return {
        "lr": F.coalesce(two(r"lr(\d+)em(\d+)", "e-"), two(r"lr(\d+)e(\d+)", "e-"), F.lit("")),
        "clip": F.coalesce(two(r"clip(\d+)p(\d+)", "."), F.lit("")),
        "skip_ratio": got(r"skip(\d+)"),
        "skip_max": got(r"skip\d+_(\d+)"),
        "epochs": F.when(text.rlike(r"epochs?\d+"), got(r"epochs?(\d+)")).otherwise(got(r"(\d+)epoch")),
        "lr_decay": F.when(text.rlike(r"lrdecay\d+"), F.concat(F.lit("lrdecay"), got(r"lrdecay(\d+)"))).otherwise(""),
    }
