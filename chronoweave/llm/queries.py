"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from chronoweave.llm import decontam, gru_lm, langid_kn, line_runs, media_ts, mixing_soft, neardup_hamming, secret_forest, substring_dedup, url_redirects
from chronoweave.session import table


def op1_decontamination(spark, sf_dir):
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_transport_streams(spark, sf_dir):
    return media_ts.read_media(media_ts.text_media(table(spark, sf_dir, "documents")))


def op3_language_id(spark, sf_dir):
    return langid_kn.language_digest(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark, sf_dir):
    return substring_dedup.removal_digest(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark, sf_dir):
    return neardup_hamming.class_digest(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark, sf_dir):
    return secret_forest.secret_digest(table(spark, sf_dir, "documents"))


def op7_soft_mixing(spark, sf_dir):
    return mixing_soft.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_url_filter(spark, sf_dir):
    return url_redirects.judge_pages(table(spark, sf_dir, "pages"))


def op9_recurrent_lm(spark, sf_dir):
    return gru_lm.score_documents(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark, sf_dir):
    return line_runs.line_digest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_transport_streams": op2_transport_streams,
    "op3_language_id": op3_language_id,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_near_dedup": op5_near_dedup,
    "op6_secret_scan": op6_secret_scan,
    "op7_soft_mixing": op7_soft_mixing,
    "op8_url_filter": op8_url_filter,
    "op9_recurrent_lm": op9_recurrent_lm,
    "op10_line_dedup": op10_line_dedup,
}

ORACLE_SQL = {
    "op4_substring_dedup": substring_dedup.WINDOW_SQL,
    "op5_near_dedup": neardup_hamming.NEAR_SQL,
    "op8_url_filter": url_redirects.URL_SQL,
    "op10_line_dedup": line_runs.LINE_SQL,
}
