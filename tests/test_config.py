import pytest

from strandix import config as K


def test_ranking():
    o = K.RankingOptions()
    assert (o.top_k, o.per_source_limit, o.min_score, o.keyword_weight, o.keyword_heading_weight, o.pool, o.repeat) == (4, 2, 0, 0.3, 2, 8, 2)
    for bad in ({"top_k": 0}, {"top_k": 1.5}, {"top_k": True}, {"per_source_limit": 0}, {"min_score": 1.1}, {"keyword_weight": -0.1}, {"keyword_heading_weight": float("nan")}):
        with pytest.raises(ValueError):
            K.RankingOptions(**bad)


def test_ingest_and_runtime():
    o, r = K.IngestOptions(), K.RuntimeOptions()
    assert (o.chunk_size, o.chunk_overlap, o.heading_weight, o.embed_batch_size, o.concurrency) == (600, 80, 2, 32, 1)
    assert (r.timeout_ms, r.retries, r.concurrency, r.temperature) == (60_000, 2, 4, 0.2)
    for bad in ({"chunk_size": 0}, {"chunk_overlap": 600}, {"heading_weight": -1}, {"embed_batch_size": 0}):
        with pytest.raises(ValueError):
            K.IngestOptions(**bad)


def test_extensions():
    assert K.normalize_extensions([" MD ", ".txt", "md", ""]) == [".md", ".txt"] and K.normalize_extensions() == [".md", ".txt"]
    with pytest.raises(ValueError):
        K.normalize_extensions([" "])


def test_environment():
    env = {"A": " x ", "B": "", "N": "1.5", "I": "7", "T": "Yes", "F": "off", "L": "a, b  c,,", "BAD": "z"}
    assert K.env_text("A", "d", env) == "x" and K.env_text("B", "d", env) == "d" and K.env_number("N", 0, env) == 1.5 and K.env_int("I", 0, env) == 7 and K.env_int("B", 3, env) == 3
    assert K.env_bool("T", False, env) and not K.env_bool("F", True, env) and K.env_bool("B", True, env) and K.env_list("L", (), env) == ["a", "b", "c"]
    assert K.env_choice("A", ["x", "y"], "y", env) == "x"
    for f in (lambda: K.env_int("N", 0, env), lambda: K.env_number("BAD", 0, env), lambda: K.env_bool("BAD", True, env), lambda: K.env_choice("BAD", ["x"], "x", env)):
        with pytest.raises(ValueError):
            f()


def test_keys_stay_out_of_sight():
    assert "secret" not in repr(K.ModelConfig("openai", "m", api_key="secret"))
    with pytest.raises(ValueError):
        K.ModelConfig("nobody", "m")


def test_default_prompt_names_the_unknown_answer():
    assert "不知" in K.PromptOptions(unknown_answer="不知").system and K.PromptOptions(system_prompt="s").system == "s"
