"""Reports that run at the same time in one session."""

from ledgerlens.plans import catalog
from tests.test_shared_folder import given_tables


def test_catalog_reports_do_not_depend_on_the_selected_database(spark, tmp_path, monkeypatch):
    """The selected database belongs to the session: another report may select its own between two
    lookups of this one."""
    folder = given_tables(spark, tmp_path)
    names = ["cat_accounts_per_region", "cat_pat_3a_running_total", "cat_pat_3b_amount_rank", "cat_pat_3e_risk_scores",
             "cat_vw_account_risk_profile"]
    alone = {n: sorted(map(str, catalog.run(spark, folder, n).collect())) for n in names}
    run_sql = type(spark).sql
    for method in ("sql", "table"):
        def beside(self, text, *args, _call=getattr(type(spark), method), **kwargs):
            if not text.strip().upper().startswith("USE"):
                run_sql(self, "USE default")
            return _call(self, text, *args, **kwargs)
        monkeypatch.setattr(type(spark), method, beside)
    for n in names:
        assert alone[n] and sorted(map(str, catalog.run(spark, folder, n).collect())) == alone[n], n
