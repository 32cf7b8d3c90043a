import pytest

from sparktap.sources import settings, sinks


def test_settings_of_files_and_variables(tmp_path):
    pytest.importorskip("yaml")
    f = tmp_path / "a.yaml"
    f.write_text("kafka_topic: t\nports: [80, 443]\ncapture_tls: false\noutputs:\n  - type: stdout\n")
    got = settings.from_file(str(f), {"SPARKTAP_KAFKA_TOPIC": "u", "SPARKTAP_SSL_BINARY_PATHS": " /a, ,/b ", "OTHER": "x"})
    assert (got.kafka_topic, got.ports, got.capture_tls, got.ssl_binary_paths, got.outputs) == ("u", (80, 443), False, ("/a", "/b"), ({"type": "stdout"},))
    assert settings.from_file(str(tmp_path / "none"), {"SPARKTAP_KAFKA_TOPIC": "u"}) == settings.Settings()
    f.write_text("")
    assert settings.from_file(str(f), {}) == settings.Settings()
    with pytest.raises(ValueError, match="nope"):
        settings.from_env({"SPARKTAP_NOPE": "1"})
    env = settings.from_env({"SPARKTAP_CAPTURE_TLS": "False", "SPARKTAP_PORTS": "80,443", "SPARKTAP_CAPTURE_PROC_EVENTS": "TRUE"})
    assert env.capture_tls is False and env.capture_proc_events is True and env.ports == (80, 443)


def test_sink_plan():
    own = [{"type": "file", "path": "x"}]
    assert [o["type"] for o in settings.sink_plan(own)] == ["stdout", "file"]
    assert settings.sink_plan([{"type": "stdout"}], stdout=False) == []
    plan = settings.sink_plan([{"type": "stdout", "rows": 3}], file="/out", brokers="a:1, b:2", topic="t")
    assert plan == [{"type": "stdout", "rows": 3}, {"type": "file", "path": "/out"}, {"type": "kafka", "servers": "a:1,b:2", "topic": "t"}]
    assert settings.sink_plan(own, brokers="a:1") == settings.sink_plan(own)
    assert [k for k, _ in sinks.build(plan)[0]] == ["stdout", "file", "kafka"] and sinks.build(plan)[1] == []
