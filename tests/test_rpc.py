"""The JSON-RPC surface, without Spark."""

import json

from loomquest import rpc


def said(*messages, call=lambda name, args: f"{name} {args}"):
    out = []
    rpc.serve([m if isinstance(m, str) else json.dumps(m) for m in messages], lambda s: out.append(json.loads(s)), call)
    return out


def test_protocol():
    got = said({"id": 1, "method": "initialize", "params": {}}, {"method": "notifications/initialized"}, "not json", "", {"id": 2, "method": "ping"}, {"id": 3, "method": "tools/list"}, {"id": 4, "method": "x"})
    assert [g["id"] for g in got] == [1, 2, 3, 4] and got[0]["result"]["serverInfo"]["name"] == "loomquest"
    assert [t["name"] for t in got[2]["result"]["tools"]] == ["web_search", "start_campaign", "read_campaign"] and got[3]["error"]["code"] == -32601


def test_calls():
    ask = lambda name, **a: {"id": 1, "method": "tools/call", "params": {"name": name, "arguments": a}}
    assert said(ask("web_search", query="q"))[0]["result"]["content"][0]["text"] == "web_search {'query': 'q'}"
    assert said(ask("nothing"))[0]["error"]["code"] == -32602

    def fails(name, args):
        raise ValueError("query is required")

    assert said(ask("web_search"), call=fails)[0]["result"] == {"content": [{"type": "text", "text": "ValueError: query is required"}], "isError": True}


def test_start_and_read(tmp_path, monkeypatch):
    monkeypatch.setenv("LOOM_OUT_DIR", str(tmp_path))
    launched = []
    (tmp_path / "history-of-tea.done").write_text("old")
    text = rpc.called("start_campaign", {"question": "history of tea"}, launch=lambda cmd, **k: launched.append(cmd))
    assert "Started in the background" in text and launched[0][-2] == "--campaign" and not (tmp_path / "history-of-tea.done").exists()
    (tmp_path / "history-of-tea.jsonl").write_text("{}\n{}\n")
    assert "history-of-tea is at work; 2 queries answered" in rpc.called("read_campaign", {"slug": "History of tea"})
    (tmp_path / "history-of-tea.report.md").write_text("# Answer")
    (tmp_path / "history-of-tea.done").write_text("done")
    assert rpc.called("read_campaign", {"slug": "history of tea"}) == "# Answer"
