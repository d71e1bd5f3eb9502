import time

from lacuna.plans import scan
from lacuna.sources import state
from lacuna.streaming import watch


def test_watch_takes_suppressions(spark, tmp_path):
    """The project's suppressions hold in watch mode as they do in a scan."""
    root = tmp_path / "tree"
    (root / "api").mkdir(parents=True)
    (root / "api" / "users.py").write_text("".join(f"{'@audit' if i else ''}\ndef f{i}(a):\n    pass\n\n" for i in range(5)))
    (root / "lacuna.toml").write_text('[[suppress]]\nentity = "api/users.py::f0"\nrule = "@audit"\n')
    seen = []
    store = state.StateStore(spark, str(tmp_path / "s"))
    query = watch.watch(spark, str(root), store, lambda r, n: seen.append(r.gaps.filter("feature_value = '@audit'").count()), checkpoint=str(tmp_path / "c"), once=True)
    query.awaitTermination(120)
    assert seen == [0]


def test_watch_equals_a_scan_and_sees_deletions(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "api").mkdir(parents=True)
    body = "".join(f"{'@audit' if i else ''}\ndef f{i}(a):\n    pass\n\n" for i in range(5))
    (root / "api" / "users.py").write_text(body)
    (root / "api" / "more.py").write_text("class Idle:\n    pass\n")
    seen = []
    store = state.StateStore(spark, str(tmp_path / "s"))

    def wait(n):
        until = time.time() + 120
        while len(seen) < n and time.time() < until and query.isActive:
            time.sleep(0.2)
        assert len(seen) == n, query.exception()
        return seen[-1]

    query = watch.watch(
        spark, str(root), store, lambda r, n: seen.append(sorted(g.gap_id for g in r.gaps.collect())), checkpoint=str(tmp_path / "c"), interval="1 second"
    )
    try:
        first = wait(1)
        whole = scan.scan_tree(spark, str(root))
        assert first == sorted(g.gap_id for g in whole.gaps.collect()) and any("Idle" in g for g in first)
        whole.release()
        (root / "api" / "more.py").unlink()
        assert not any("Idle" in g for g in wait(2))
    finally:
        query.stop()
