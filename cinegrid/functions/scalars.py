"""Scalar functions of the catalogue, as Column expressions. Nulls give null unless stated otherwise."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinegrid.functions.words import SEPARATORS

#: Words that the profile panel leaves out.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "it",
    "as", "was", "are", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would",
    "could", "should", "may", "might", "shall", "can", "not", "no", "nor", "so", "if", "then", "than", "that",
    "this", "these", "those", "which", "who", "whom", "what", "where", "when", "how", "all", "each", "every",
    "both", "few", "more", "most", "other", "some", "such", "only", "own", "same", "too", "very", "just", "about",
    "up", "out", "into", "over", "after", "before", "between", "under", "through", "during", "while", "its",
    "their", "his", "her", "my", "your", "our", "he", "she", "they", "we", "you", "i", "me", "him", "us", "them",
    "also", "there", "here",
)

#: The canonical order of fields; others follow by name.
FIELD_ORDER = (
    "height", "width", "duration", "num_frames", "file_size_mb", "fps", "clip_std", "score", "flow_mean_magnitude",
    "flow_max_magnitude", "flow_min_magnitude", "flow_std_magnitude", "flow_temporal_std", "phash_mean_change",
    "phash_max_change", "phash_std_change", "phash_temporal_std", "mean_volume", "max_volume",
)

#: Units of file sizes; frames of a sprite.
UNITS = ("B", "KB", "MB", "GB", "TB", "PB")
SPRITE_COLUMNS, SPRITE_ROWS = 5, 5


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once: a lambda's outer columns would be, once per element, where the optimizer
    puts their expressions in their place."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def number(c: Column) -> Column:
    """A double without NaN: NaN counts as missing everywhere in the engine."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def or_else(c: Column, other: Column) -> Column:
    """``other`` where the text is null or empty."""
    return F.coalesce(F.when(c != "", c), other)


def parsed_number(c: Column) -> Column:
    """The number of a trimmed cell; null for empty cells and junk."""
    return F.nullif(F.trim(c), F.lit("")).try_cast("double")


def content_words(text: Column) -> Column:
    """Lower-cased words of more than one character that are no stop words, repetitions included."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), f"(?U){SEPARATORS}")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))


def truncated(text: Column, most: int = 120) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def escaped(text: Column) -> Column:
    """Text safe between HTML tags."""
    out = F.coalesce(text, F.lit(""))
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def highlight_terms(query: str) -> list[str]:
    """What a query makes stand out: quoted phrases first, then words and alternatives; excluded words do not."""
    terms = re.findall("'([^']+)'", query)
    for part in re.sub("'([^']+)'", "", query).split():
        if not part.startswith("!"):
            terms += [t for t in part.split("|") if t]
    return terms


def highlighted(text: Column, query: str) -> Column:
    """The escaped text with the query's terms in bold and underlined, in any case."""
    terms = highlight_terms(query or "")
    if not terms:
        return escaped(text)
    return F.regexp_replace(escaped(text), "(?iu)(" + "|".join(r"\Q" + t.replace(r"\E", r"\E\\E\Q") + r"\E" for t in terms) + ")", "<b><u>$1</u></b>")


def shard(sample_id: Column) -> Column:
    """The two-level folder of a sample: the first four hex digits of its SHA-256."""
    h = F.sha2(sample_id, 256)
    return F.concat(F.substring(h, 1, 2), F.lit("/"), F.substring(h, 3, 2))


def sample_path(sample_id: Column, artifact: Column | None = None) -> Column:
    parts = [F.lit("samples"), shard(sample_id), sample_id]
    return F.concat_ws("/", *parts, *([artifact] if artifact is not None else []))


def random_key(seed: int, name: Column) -> Column:
    """A key whose order is a shuffle that the seed fixes."""
    return F.md5(F.concat(F.lit(f"{seed}_"), name))


def without_prefix(sample_id: Column) -> Column:
    """The name behind the first underscore; without one the whole."""
    at = F.instr(sample_id, "_")
    return F.when(at > 0, F.substring(sample_id, at + 1, F.length(sample_id))).otherwise(sample_id)


def quantised(v: Column, lo: Column, hi: Column) -> Column:
    """0 to 255 of a value within lo and hi, halves to even; a range of zero counts as one."""
    span = F.when(hi > lo, hi - lo).otherwise(1.0)
    return F.when(v.isNotNull() & lo.isNotNull() & hi.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(255), F.bround((v - lo) / span * 255).cast("int"))))


def dequantised(q: Column, lo: Column, hi: Column) -> Column:
    return lo + q / F.lit(255.0) * (hi - lo)


def log_scaled(v: Column) -> Column:
    return F.when(v > 0, F.log10(v)).when(v.isNotNull(), 0.0)


def file_size(n: Column) -> Column:
    """Bytes for people, in steps of 1024: whole numbers as they are, others with one decimal."""
    out = None
    for i, unit in reversed(list(enumerate(UNITS))):
        v = n.cast("double") / float(1024**i)
        text = F.when(v == F.floor(v), F.concat(F.floor(v).cast("string"), F.lit(unit))).otherwise(F.concat(F.format_string("%.1f", v), F.lit(unit)))
        out = text if out is None else F.when(F.abs(v) < 1024, text).otherwise(out)
    return F.when(n.isNotNull(), out)


def shown(v: Column, decimals: int = 2) -> Column:
    """Whole numbers as such, others with fixed decimals, null as an empty text."""
    return F.when(v.isNull(), "").when(v == F.floor(v), F.floor(v).cast("string")).otherwise(F.format_string(f"%.{decimals}f", v))


def badge(sort_value: Column | None, score: Column) -> Column:
    """What a result shows: the value it is sorted by, else its score times 100 with one decimal."""
    own = F.when(score.isNotNull(), shown(score * 100, 1)).otherwise("")
    return own if sort_value is None else F.when(sort_value.isNotNull(), shown(sort_value)).otherwise(own)


def sort_key(text: str) -> tuple[str, str]:
    """``field_direction`` taken apart at the last underscore. ``random`` and keys without one are descending."""
    if not text:
        return "", ""
    field, bar, direction = text.rpartition("_")
    return (field, direction) if bar and text != "random" else (text, "desc")


def clamped(i: Column, n: int) -> Column:
    return F.when(i.isNotNull(), F.least(F.lit(n - 1), F.greatest(F.lit(0), i)))


def filter_step(whole: Column, lo: Column, hi: Column) -> Column:
    """The step of a field's slider: one for whole numbers, else finer the narrower the range; 0.01 where it is not known."""
    span = hi - lo
    return F.when(whole, 1.0).when(span.isNull(), 0.01).when(span <= 1, 0.001).when(span <= 10, 0.01).when(span <= 100, 0.1).otherwise(1.0)


def snapped(v: Column, step: float) -> Column:
    """A slider's value, rounded to the decimals that its step has."""
    return F.round(v, 0 if step >= 1 else next(d for d in range(1, 16) if step * 10**d >= 1))


def bin_centre(i: Column, lo: Column, hi: Column, bins: int) -> Column:
    return lo + (i + 0.5) * (hi - lo) / bins


def sprite_cell(i: Column) -> Column:
    """Where a frame stands in the sprite, in per cent of its free width and height."""
    x = (i % SPRITE_COLUMNS) * 100 / (SPRITE_COLUMNS - 1)
    y = F.floor(i / SPRITE_COLUMNS) * 100 / (SPRITE_ROWS - 1)
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def frame_indices(n: Column, count: int = SPRITE_COLUMNS * SPRITE_ROWS) -> Column:
    """Frames of the sprite: evenly spaced from the first to the last, cut to whole numbers."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor(i * (n - 1) / (count - 1)).cast("int"))


def sampled_frames(n: Column) -> Column:
    """Frames to decode: first, middle, last and those of the sprite, ascending, each once."""
    ends = F.array(F.lit(0), F.floor(n / 2).cast("int"), F.greatest(F.lit(0), n - 1).cast("int"))
    return F.array_sort(F.array_distinct(F.concat(ends, frame_indices(n))))


def target_size(width: Column, height: Column, target: int) -> Column:
    """The size whose smaller side is ``target``, never enlarged; the other side keeps the ratio and is made even."""
    small = F.least(width, height, F.lit(target))
    other = (F.round(F.greatest(width, height) * small / F.least(width, height) / 2) * 2).cast("int")
    known = width.isNotNull() & height.isNotNull()
    return F.when(known, F.struct(F.when(width <= height, small).otherwise(other).alias("width"), F.when(width <= height, other).otherwise(small).alias("height")))


def contained(width: Column, height: Column, box_width: int, box_height: int) -> Column:
    """The size and offset of an image scaled to fit a box, centred."""
    scale = F.least(F.lit(float(box_width)) / width, F.lit(float(box_height)) / height)
    w, h = F.greatest(F.lit(1), (width * scale).cast("int")), F.greatest(F.lit(1), (height * scale).cast("int"))
    offsets = (F.floor((F.lit(box_width) - w) / 2).cast("int").alias("x"), F.floor((F.lit(box_height) - h) / 2).cast("int").alias("y"))
    return F.when(width.isNotNull() & height.isNotNull(), F.struct(w.alias("width"), h.alias("height"), *offsets))


def grid_cells(width: Column, height: Column, columns: int = SPRITE_COLUMNS, rows: int = SPRITE_ROWS) -> Column:
    """The cells of an image cut into a grid, row by row: array of (x, y, width, height); what does not divide is left out."""
    w, h = F.floor(width / columns).cast("int"), F.floor(height / rows).cast("int")
    cell = lambda i: F.struct((i % columns * w).alias("x"), (F.floor(i / columns).cast("int") * h).alias("y"), w.alias("width"), h.alias("height"))
    return F.when(width.isNotNull() & height.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(columns * rows - 1)), cell))


def composed(count: Column, cell_width: int, cell_height: int, columns: int = SPRITE_COLUMNS) -> Column:
    """The size of a sprite of ``count`` cells, and the offsets of its cells, row by row."""
    across = F.least(count, F.lit(columns))
    rows = F.ceil(count / columns).cast("int")
    cells = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((i % columns * cell_width).alias("x"), (F.floor(i / columns) * cell_height).cast("int").alias("y")))
    return F.when(count > 0, F.struct((across * cell_width).alias("width"), (rows * cell_height).alias("height"), cells.alias("cells")))


def half_even(v: Column, decimals: int) -> Column:
    """Rounded with halves to the even digit, by the number's shortest decimal form."""
    return F.bround(v, decimals)


def media_fields(frames: Column, fps: Column, size: Column) -> tuple[Column, Column]:
    """Duration in seconds and size in MB, of a probe."""
    rate = F.when(fps.isNotNull(), F.greatest(fps, F.lit(1e-6)))
    return F.round(frames / rate, 3), F.round(size / 1048576.0, 2)


def page_count(total: Column, size: int) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(total / size))


def canonical_rank(field: Column, dynamic: Column | None = None) -> list[Column]:
    """Sort keys for field names: dynamic ones first, then the fixed order, then by name."""
    known = F.array_position(F.array(*map(F.lit, FIELD_ORDER)), field)
    first = F.when(dynamic, 0).otherwise(1) if dynamic is not None else F.lit(1)
    return [first, F.when(known > 0, known).otherwise(len(FIELD_ORDER) + 1), field]
