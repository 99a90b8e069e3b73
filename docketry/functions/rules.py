"""Triage of sweep and pipeline rows: what went wrong, and what to do about it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions.text import contains_any

#: Signs of a passing network fault in an error message; case aside.
NETWORK_SIGNS = tuple("5xx|504|503|502|500|403|auth triad|chunkedencodingerror|connectionerror|connectionreset|cookies|proxyerror|ssl|timed out|timeout".split("|"))
#: A 404 there is final wherever it is seen.
FINAL_404 = ("/decisoes-monocraticas/api/public/votos/",)
RETRY_CAP = 2


def _cases(default: Column, *pairs: tuple[Column, object]) -> Column:
    out = default
    for condition, value in reversed(pairs):
        out = F.when(condition, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def classify_error(stage: Column, status: Column, error: Column, http_status: Column) -> Column:
    """ok, transient, terminal or cross_stage for a row of the stage varrer, baixar or extrair; null for other stages.
    What isn't recognised is terminal, so that no retry runs for ever."""
    text = F.coalesce(error, F.lit(""))
    passing = contains_any(error, NETWORK_SIGNS)
    gone = F.coalesce(http_status == 404, F.lit(False))
    by_network = F.when(passing, F.lit("transient")).otherwise(F.lit("terminal"))
    is_ = lambda *names: F.coalesce(status.isin(*names), F.lit(False))
    end = F.lit("terminal")
    varrer = _cases(
        end,
        (is_("ok"), "ok"),
        (is_("unallocated", "unallocated_pid"), "terminal"),
        (F.lower(text).contains("scrape returned none"), "terminal"),
        (gone | text.contains(" 404 ") | text.startswith("404"), "terminal"),
        (is_("http_error", "fail", "error"), by_network),
    )
    baixar = _cases(
        end,
        (is_("ok", "cached"), "ok"),
        (is_("empty", "empty_response", "non_document_response"), "transient"),
        (is_("http_error") & (gone | text.contains("404 ") | text.contains("Not Found")), "terminal"),
        (is_("http_error"), by_network),
    )
    extrair = _cases(end, (is_("ok", "cached"), "ok"), (is_("no_bytes"), "cross_stage"), (is_("provider_error"), "transient"))
    return F.when(stage == "varrer", varrer).when(stage == "baixar", baixar).when(stage == "extrair", extrair)


def recovery_action(stage: Column, status: Column, error: Column, http_status: Column, url: Column) -> Column:
    """none, drop_terminal, replay, refetch_upstream, switch_provider or refetch_bytes: a known final 404 first, then
    the extraction's own statuses, then the class of the error."""
    kind = classify_error(stage, status, error, http_status)
    extract = F.coalesce(stage == "extrair", F.lit(False))
    return _cases(
        F.lit("drop_terminal"),
        (F.coalesce(http_status == 404, F.lit(False)) & contains_any(url, FINAL_404), "drop_terminal"),
        (extract & F.coalesce(status.isin("empty", "outlier_skipped"), F.lit(False)), "switch_provider"),
        (extract & F.coalesce(status == "unknown_type", F.lit(False)), "refetch_bytes"),
        (kind == "ok", "none"),
        (kind == "transient", "replay"),
        (extract & (kind == "cross_stage"), "refetch_upstream"),
    )


def retryable(kind: Column, status: Column) -> Column:
    """Whether a task is worth trying again as it is: never tried, a transport fault, or empty bytes."""
    return F.coalesce(status.isNull() | status.isin("http_error", "provider_error") | ((kind == "fetch_bytes") & (status == "empty")), F.lit(False))


def cross_stage(status: Column) -> Column:
    return F.coalesce(status == "no_bytes", F.lit(False))


def unified_kind(stage: Column, status: Column) -> Column:
    """ok, transient, cross_stage or terminal for a row of the unified log."""
    return _cases(
        F.lit("terminal"), (F.coalesce(status.isin("ok", "skipped_cached"), F.lit(False)), "ok"), (cross_stage(status), "cross_stage"), (status.isNotNull() & retryable(stage, status), "transient")
    )


def waf_shape(wall_s: Column, http_status: Column, retries: Column) -> Column:
    """Signs of a firewall: a long wait, 403, 429 or 5xx, or any retry (a count)."""
    return F.coalesce(wall_s > 15, F.lit(False)) | F.coalesce(http_status.isin(403, 429) | http_status.between(500, 599), F.lit(False)) | F.coalesce(retries > 0, F.lit(False))


#: Statuses of an extraction that another provider can mend, and which.
SWITCH_TO = {"outlier_skipped": "tesseract", "empty": "chandra"}


def recovery_bucket(kind: Column, status: Column, retry_count: Column, extractor: Column, dismissed: Column) -> Column:
    """The pile that a record goes to: dismissed; replay or cap_burnt; refetch_upstream; provider_switch;
    confirmed_unallocated; terminal_dropped. Null where nothing is left to do: it succeeded, or the other provider's
    text is there already. Dismissal goes before all."""
    what = unified_kind(kind, status)
    switch = F.coalesce((kind == "extract_text") & status.isin(*SWITCH_TO), F.lit(False))
    goal = F.lit(None).cast("string")
    for name, provider in SWITCH_TO.items():
        goal = F.when(status == name, F.lit(provider)).otherwise(goal)
    return _cases(
        F.lit("terminal_dropped"),
        (F.coalesce(dismissed, F.lit(False)), "dismissed"),
        (switch & F.coalesce(extractor == goal, F.lit(False)), F.lit(None).cast("string")),
        (what == "ok", F.lit(None).cast("string")),
        ((what == "transient") & (F.coalesce(retry_count, F.lit(0)) >= RETRY_CAP), "cap_burnt"),
        (what == "transient", "replay"),
        (what == "cross_stage", "refetch_upstream"),
        (switch, "provider_switch"),
        (F.coalesce((kind == "fetch_meta") & (status == "unallocated_pid"), F.lit(False)), "confirmed_unallocated"),
    )


def migrate_status(status: Column, error: Column) -> Column:
    """``fail`` with the old message of an unallocated number becomes ``unallocated``."""
    return F.when((status == "fail") & F.lower(F.coalesce(error, F.lit(""))).contains("scrape returned none"), F.lit("unallocated")).otherwise(status)


def sniff(head: Column) -> Column:
    """pdf, rtf, gzip, zip, html, empty or unknown by a file's first bytes (binary)."""
    h = F.hex(F.substring(head, 1, 5))
    return _cases(
        F.lit("unknown"), (head.isNull() | (h == ""), "empty"), (h.startswith("25504446"), "pdf"), (h.startswith("7B5C727466"), "rtf"), (h.startswith("1F8B"), "gzip"), (h.startswith("504B"), "zip"), (h.startswith("3C"), "html")
    )


def anomalies(n_partes: Column, n_andamentos: Column, classe: Column, pid: Column, relator: Column, assuntos: Column) -> Column:
    """Names of what is wrong with a case's shape, in a fixed order."""
    tests = (("no_class", classe.isNull() | (classe == "")), ("no_number", pid.isNull() | (pid <= 0)), ("no_parties", F.coalesce(n_partes, F.lit(0)) == 0), ("no_events", F.coalesce(n_andamentos, F.lit(0)) == 0))
    more = (("no_rapporteur", relator.isNull() | (F.trim(relator) == "")), ("no_subjects", F.coalesce(F.size(assuntos), F.lit(0)) <= 0))
    return F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(True)), F.lit(n)) for n, t in (*tests, *more)]))
