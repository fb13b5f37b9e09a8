"""A completion function over HTTP, for providers that speak the common chat-completions protocol."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from dataclasses import dataclass

# Where each provider listens, and the environment variable that holds its key.
ENDPOINTS = {
    "openai": ("https://api.openai.com/v1", "OPENAI_API_KEY"),
    "openrouter": ("https://openrouter.ai/api/v1", "OPENROUTER_API_KEY"),
}

MOST_TOKENS = 4096


@dataclass(frozen=True)
class Endpoint:
    """Called by tasks, so it is small and holds no connection; the key is read where the call is made."""

    model: str
    url: str
    key_variable: str
    timeout: float = 300.0

    def __call__(self, prompt: str) -> tuple[str, int, int]:
        """The answer and the tokens read and written; an error names its status, so that 429 is tried again."""
        key = os.environ.get(self.key_variable)
        if not key:
            raise RuntimeError(f"{self.key_variable} is not set")
        asked = {"model": self.model, "max_tokens": MOST_TOKENS, "messages": [{"role": "user", "content": prompt}]}
        headers = {"Authorization": f"Bearer {key}", "Content-Type": "application/json"}
        request = urllib.request.Request(f"{self.url.rstrip('/')}/chat/completions", json.dumps(asked).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                said = json.load(answer)
        except urllib.error.HTTPError as e:
            raise RuntimeError(f"{e.code} {e.read().decode(errors='replace')[:300]}") from None
        used = said.get("usage") or {}
        return said["choices"][0]["message"]["content"] or "", int(used.get("prompt_tokens") or 0), int(used.get("completion_tokens") or 0)


def endpoint(provider: str, model: str | None = None, url: str | None = None) -> Endpoint:
    """A provider's endpoint with its default model; an unknown provider is an error."""
    from .providers import default_model

    default_url, variable = ENDPOINTS.get(provider, (None, None))
    return Endpoint(model or default_model(provider), url or default_url, variable)
