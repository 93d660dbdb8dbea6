"""Configuration files that inherit and name other values."""

import json

import pytest

from strandex import config


def test_load(tmp_path):
    files = {
        "base.json": {"root": "/data", "paths": {"banks": "${root}/banks", "out": "${paths.banks}/out"}, "list": ["${root}", 3], "k": 8},
        "mid.json": {"inherit": "base.json", "paths": {"out": "${root}/else"}, "k": {"deep": 1}},
        "sub/top.json": {"inherit": "../mid.json", "root": "/other", "list": []},
    }
    (tmp_path / "sub").mkdir()
    for name, body in files.items():
        (tmp_path / name).write_text(json.dumps(body))
    assert config.load(str(tmp_path / "base.json")) == {"root": "/data", "paths": {"banks": "/data/banks", "out": "/data/banks/out"}, "list": ["/data", 3], "k": 8}
    assert config.load(str(tmp_path / "sub/top.json")) == {"root": "/other", "paths": {"banks": "/other/banks", "out": "/other/else"}, "list": [], "k": {"deep": 1}}
    (tmp_path / "loop.json").write_text('{"inherit": "loop.json"}')
    with pytest.raises(ValueError, match="itself"):
        config.load(str(tmp_path / "loop.json"))
    (tmp_path / "missing.json").write_text('{"a": "${b.c}"}')
    with pytest.raises(KeyError):
        config.load(str(tmp_path / "missing.json"))
