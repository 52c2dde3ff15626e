"""Intermediate tables of the operators in a folder that several users share."""

import stat

from ledgerlens import session
from ledgerlens.llm.common import stored


def test_folder_of_stored_tables_has_the_rights_of_the_shared_folder(spark, tmp_path, monkeypatch):
    """Sessions of other users write in it too, whoever made it first."""
    tmp_path.chmod(0o1777)
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    assert stored(spark.range(3), "rows").count() == 3
    assert stat.S_IMODE((tmp_path / "llm").stat().st_mode) == 0o1777
