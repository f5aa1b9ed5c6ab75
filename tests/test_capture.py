"""Folders of sources: what is taken, what is rejected, limits, changes."""

import pytest

from factloom.sources import capture


def _folder(base):
    files = {
        "Cargo.toml": b"[package]", "src/lib.rs": "pub fn café() {}\r\n".encode(), "src/a b+c/mod.rs": b"mod x;", "src/notes.txt": b"no", "target/debug/build.rs": b"fn skipped() {}", "src/node_modules/x.rs": b"fn skipped() {}",
        "src/latin.rs": b"// caf\xe9", "src/empty.rs": b"", "rust-toolchain": b"stable", "src/target.rs": b"fn kept() {}",
    }
    for name, content in files.items():
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return str(base)


def test_sources_manifests_and_rejected_files(spark, tmp_path):
    root = _folder(tmp_path / "work space")
    found = capture.capture(spark, root)
    texts = {r.path: r.text for r in found.files.collect()}
    assert texts == {"src/lib.rs": "pub fn café() {}\r\n", "src/a b+c/mod.rs": "mod x;", "src/target.rs": "fn kept() {}"}
    assert {r.path for r in found.manifests.collect()} == {"Cargo.toml", "rust-toolchain"}
    assert [tuple(r) for r in found.rejected.collect()] == [("src/latin.rs", "not_utf8")]
    assert {r.path: r.content_hash for r in found.files.collect()} == {r.path: r.content_hash for r in capture.capture(spark, f"file://{tmp_path}/work space").files.collect()}


@pytest.mark.parametrize("limits, said", [({"max_files": 5}, "6 files"), ({"max_file_bytes": 10}, "src/lib.rs has"), ({"max_total_bytes": 40}, "bytes, 40 at most")])
def test_limits_hold_before_anything_is_read(spark, tmp_path, monkeypatch, limits, said):
    root = _folder(tmp_path / "w")
    listed = capture._listed
    monkeypatch.setattr(capture, "_listed", lambda spark, root, content: listed(spark, root, content) if not content else pytest.fail("read"))
    with pytest.raises(capture.LimitExceeded, match=said):
        capture.capture(spark, root, **limits)


def test_a_change_between_listings_is_an_error(spark, tmp_path, monkeypatch):
    root = _folder(tmp_path / "w")
    listed = capture._listed

    def changing(spark, root, content):
        if content:
            (tmp_path / "w/src/lib.rs").write_bytes(b"fn other_text() { 1 }")
        return listed(spark, root, content)

    monkeypatch.setattr(capture, "_listed", changing)
    with pytest.raises(capture.SourceChanged):
        capture.capture(spark, root)


def test_a_folder_without_sources(spark, tmp_path):
    (tmp_path / "none").mkdir()
    found = capture.capture(spark, str(tmp_path / "none"))
    assert found.files.count() == found.manifests.count() == found.rejected.count() == 0
