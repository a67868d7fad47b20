import pytest

from tidewatch import config


def test_defaults_and_merge(tmp_path):
    assert config.load(tmp_path / "none.yaml") == config.Config()
    f = tmp_path / "config" / "config.yaml"
    f.parent.mkdir()
    f.write_text("collector:\n  session_minutes: 15\ndetection:\n  ensemble_threshold: 3\nlogging:\n")
    got = config.load(start=tmp_path / "config", aliases={"collector": "input"})
    assert (got.input.session_minutes, got.input.alerts_path, got.detection.ensemble_threshold, got.detection.contamination) == (15, config.Input().alerts_path, 3, 0.05)
    for text in (f.read_text(), "detectoin:\n  ensemble_threshold: 3\n"):  # an alias not given, a misspelt section
        f.write_text(text)
        with pytest.raises(ValueError, match="unknown section"):
            config.load(f)
    f.write_text("")
    assert config.load(f) == config.Config()
    f.write_text("detection:\n  nonsense: 1\n")
    with pytest.raises(ValueError):
        config.load(f)
    with pytest.raises(ValueError):
        config.merged({"nonsense": {}})


def test_sample_is_the_defaults():
    from pathlib import Path

    assert config.load(Path(__file__).parents[1] / "config" / "sample.yaml") == config.Config()
