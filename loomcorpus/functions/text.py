"""Column functions over text: keys, paths, JSON in model output, HTML attributes, durations."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomcorpus.schemas import MODEL_DIMENSIONS

KEY_PATTERN = r"viewkey=([a-zA-Z0-9]+)"
FENCE = "```"


def first_group(text: Column, pattern: str = KEY_PATTERN) -> Column:
    """First capture of a pattern anywhere in the text; null where it does not match."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def local_path(folder: str, key: Column, suffix: str = ".jpg") -> Column:
    return F.concat(F.lit(folder.rstrip("/") + "/"), key, F.lit(suffix))


def sharded_path(prefix: str, key: Column) -> Column:
    """``prefix`` with the key's first three groups of three characters as folders."""
    return F.concat_ws("/", F.lit(prefix.rstrip("/")), F.substring(key, 1, 3), F.substring(key, 4, 3), F.substring(key, 7, 3), key)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) == ""


def basename(path: Column) -> Column:
    """Last component of a path, trailing slashes ignored; null, blank and 'nan' give null."""
    clean = strip(path)
    named = F.element_at(F.filter(F.split(clean, "/"), lambda x: x != ""), -1)
    return F.when((clean != "") & (F.lower(clean) != "nan") & (F.regexp_replace(clean, "/", "") != ""), named)


def stem(name: Column) -> Column:
    """Without the last suffix."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def absolute(path: Column, root: str) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def json_slice(raw: Column) -> Column:
    """The stretch of model output that should be a JSON object; null where there is none.

    White space is stripped; of a fenced answer the part after the first fence is taken without
    its language tag; then all from the first opening to the last closing brace.
    """
    clean = strip(raw)
    inner = F.get(F.split(clean, FENCE), F.lit(1))
    inner = strip(F.regexp_replace(inner, r"^(?i:json)", ""))
    body = F.when(clean.startswith(FENCE), inner).otherwise(clean)
    begin = F.instr(body, "{")
    end = F.length(body) - F.instr(F.reverse(body), "}") + 1
    have = (begin > 0) & (F.instr(body, "}") > 0) & (end > begin)
    return F.when(have, F.substring(body, begin, end - begin + 1))


def json_object(raw: Column) -> Column:
    """``json_slice`` as a VARIANT; null where it does not parse (NaN and repeated keys included)."""
    return F.try_parse_json(json_slice(raw))


#: Character references that pages write in attribute values; the ampersand comes last, so that nothing is decoded twice.
REFERENCES = {"&quot;": '"', "&#34;": '"', "&#x22;": '"', "&apos;": "'", "&#39;": "'", "&#x27;": "'", "&lt;": "<", "&gt;": ">", "&#38;": "&", "&#x26;": "&", "&amp;": "&"}


def json_object_lenient(raw: Column) -> Column:
    """``json_slice`` as JSON text that also takes NaN, Infinity and repeated keys, of which the last counts; null if it is no object."""

    @F.pandas_udf("string")
    def parsed(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                found = json.loads(text) if text is not None else None
            except ValueError:
                found = None
            return json.dumps(found, ensure_ascii=False) if isinstance(found, dict) else None

        return pd.Series([one(t) for t in texts], dtype=object)

    return parsed(json_slice(raw))


def attribute(tag: Column, name: str) -> Column:
    """Value of a tag's attribute, in double, single or no quotes, as written; null without one."""
    found = [F.regexp_extract(tag, rf"(?i)[\s\"']{name}\s*=\s*{value}", 1) for value in (r'"([^"]*)"', r"'([^']*)'", r"([^\s\"'>]+)")]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in found])


def meta_content(html: Column, name: str = "og:image") -> Column:
    """``content`` of the first meta element with that ``property``, in any attribute order, references decoded."""
    quoted = name.replace(".", r"\.")
    inside = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*"
    key = rf"[\s\"']property\s*=\s*(?:\"{quoted}\"|'{quoted}'|{quoted}(?=[\s/>]))"
    text = attribute(F.regexp_extract(html, rf"(?i)(<meta(?=[\s/]){inside}?{key}{inside}>)", 1), "content")
    for written, sign in REFERENCES.items():
        text = F.replace(text, F.lit(written), F.lit(sign))
    return text


def human_duration(seconds: Column) -> Column:
    """``12.3s``, ``5m 1s`` or ``1h 2m 3s``; negatives count as zero."""
    s = F.greatest(seconds.cast("double"), F.lit(0.0))
    whole = F.floor(s).cast("long")
    return (
        F.when(s < 60, F.format_string("%.1fs", s))
        .when(s < 3600, F.format_string("%dm %ds", F.floor(whole / 60), whole % 60))
        .otherwise(F.format_string("%dh %dm %ds", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60))
    )


def utc_run_id(at: Column | None = None) -> Column:
    """Compact UTC stamp that names a run."""
    return F.date_format(F.current_timestamp() if at is None else at, "yyyyMMdd'T'HHmmss'Z'")


def safe_share(part: Column, whole: Column, scale: float = 100.0) -> Column:
    """``scale * part / whole``, and 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double") * scale, whole.cast("double")), F.lit(0.0))


def cut_raw(raw: Column, failed_request: Column | None = None, limit: int = 2000) -> Column:
    """Model output as logged: null if empty, cut to ``limit`` unless it tells of a request error."""
    cut = F.when(raw != "", F.substring(raw, 1, limit))
    return cut if failed_request is None else F.when(failed_request, raw).otherwise(cut)


def group_label(group: Column) -> Column:
    """``noise`` for -1, else the number."""
    return F.when(group == -1, F.lit("noise")).otherwise(group.cast("string"))


def model_dimension(model: Column) -> Column:
    """Vector length of a known model, else null."""
    known = F.create_map(*[F.lit(x) for pair in MODEL_DIMENSIONS.items() for x in pair])
    return F.try_element_at(known, model)
