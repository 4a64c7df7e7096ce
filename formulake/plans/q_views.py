"""The derived views themselves, checked whole."""

from __future__ import annotations

from formulake.plans import views as P
from formulake.plans.registry import query
from formulake.plans.sqlviews import sql

FORM_COLS = ["row_id", "study_small", "study_big", "ratio_raw", "y10", "outcome_raw", "name_raw",
             "peg_name", "cargo_raw", "np", "ph", "size", "pdi", "zeta"]


@query("view_form", sql("form", f"SELECT {', '.join(FORM_COLS)} FROM form"))
def view_form(spark, sf_dir):
    return P.form(spark, sf_dir).select(*FORM_COLS)


@query("view_articles", sql("articles", "SELECT doc_id, title, body FROM articles"))
def view_articles(spark, sf_dir):
    return P.articles(spark, sf_dir)


@query("view_claims", sql("claims", "SELECT * FROM claims"))
def view_claims(spark, sf_dir):
    return P.claims(spark, sf_dir)


@query("view_cells", sql("cells", "SELECT * FROM cells"))
def view_cells(spark, sf_dir):
    return P.cells(spark, sf_dir)


@query("view_oof", sql("oof", "SELECT row_id, study, fold, x, y, pred FROM oof"))
def view_oof(spark, sf_dir):
    return P.oof(spark, sf_dir).select("row_id", "study", "fold", "x", "y", "pred")


@query("view_oof_small", sql("oof_small", "SELECT row_id, study, fold, x, y, pred FROM oof"))
def view_oof_small(spark, sf_dir):
    return P.oof(spark, sf_dir, "study_small").select("row_id", "study", "fold", "x", "y", "pred")
