"""A language model behind an HTTP service that takes a list of messages: requests, history and settings."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from kinfold.plans.ask import read_env

#: (URL, headers, body) to the reply's body.
Post = Callable[[str, dict[str, str], bytes], bytes]
TIMEOUT = 60


def post(url: str, headers: dict[str, str], body: bytes) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=TIMEOUT) as reply:
        return reply.read()


def setting(name: str, env_file: str | Path = ".env") -> str | None:
    """A setting from the environment, or else from a file of KEY=value lines."""
    path = Path(env_file)
    return os.environ.get(name) or (read_env(path.read_text()).get(name) if path.is_file() else None) or None


@dataclass
class Client:
    """send() asks with all that was said before; it can be a speaker of ask.Session.

    The key comes from the argument, $KINFOLD_API_KEY or the .env file, as do the model's name ($KINFOLD_MODEL) and the standing instructions ($KINFOLD_SYSTEM).
    Replies are {"content": [{"text"}], "usage": {"input_tokens", "output_tokens"}} or {"error": {"message"}}.
    """

    url: str
    key: str | None = None
    model: str | None = None
    system: str | None = None
    max_tokens: int = 1024
    key_header: str = "x-api-key"
    headers: dict[str, str] = field(default_factory=dict)
    env_file: str | Path = ".env"
    transport: Post = post
    history: list[dict[str, str]] = field(default_factory=list)
    usage: dict[str, int] = field(default_factory=dict)

    def body(self, message: str, system: str | None = None) -> dict:
        out = {"model": self.model or setting("KINFOLD_MODEL", self.env_file), "max_tokens": self.max_tokens, "messages": [*self.history, {"role": "user", "content": message}]}
        system = system or self.system or setting("KINFOLD_SYSTEM", self.env_file)
        return out | ({"system": system} if system else {})

    def send(self, message: str, system: str | None = None) -> str:
        """The reply's text; it and the message are kept only if the request succeeds."""
        key = self.key or setting("KINFOLD_API_KEY", self.env_file)
        if not key:
            raise RuntimeError("no key: give one, or set KINFOLD_API_KEY in the environment or in a .env file")
        raw = self.transport(self.url, {"content-type": "application/json", self.key_header: key} | self.headers, json.dumps(self.body(message, system)).encode())
        try:
            reply = json.loads(raw)
        except ValueError as e:
            raise RuntimeError(f"the reply is not JSON: {e}\n{raw[:1000]!r}") from e
        if "error" in reply:
            raise RuntimeError(f"the service says: {(reply['error'] or {}).get('message', 'unknown error')}")
        content = reply.get("content") or [{}]
        text = content[0].get("text", "")
        self.usage = {k: int((reply.get("usage") or {}).get(k, 0)) for k in ("input_tokens", "output_tokens")}
        self.history += [{"role": "user", "content": message}, {"role": "assistant", "content": text}]
        return text

    def reset(self) -> None:
        self.history.clear()

    def __call__(self, system: str, message: str) -> str:
        """As a speaker, whose calls stand alone: nothing said before goes along."""
        kept, self.history = self.history, []
        try:
            return self.send(message, system)
        finally:
            self.history = kept
