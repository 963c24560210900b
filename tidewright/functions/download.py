"""DOWNLOAD(uri): the bytes at a URI under a policy; null on any failure."""

from __future__ import annotations

import ipaddress
import os
import socket
import urllib.error
import urllib.parse
import urllib.request
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidewright.errors import EngineError


@dataclass(frozen=True)
class DownloadPolicy:
    """Which URIs may be read, and how much of them."""

    schemes: frozenset[str] = frozenset({"file", "http", "https"})
    allowed_hosts: frozenset[str] = frozenset()
    denied_hosts: frozenset[str] = frozenset()
    allowed_networks: tuple[str, ...] = ()
    denied_networks: tuple[str, ...] = ()
    allow_private: bool = False
    max_bytes: int = 64 << 20
    timeout: float = 30.0
    max_redirects: int = 5

    def check_address(self, address: str) -> None:
        ip = ipaddress.ip_address(address)
        if any(ip in ipaddress.ip_network(n) for n in self.denied_networks):
            raise EngineError(f"the address {address} is denied")
        if any(ip in ipaddress.ip_network(n) for n in self.allowed_networks):
            return
        if self.allowed_networks or not self.allow_private and not ip.is_global:
            raise EngineError(f"the address {address} is not allowed")

    def check(self, uri: str, resolve=socket.getaddrinfo) -> urllib.parse.SplitResult:
        """The parsed URI; an error if the policy forbids it."""
        parts = urllib.parse.urlsplit(uri)
        scheme = parts.scheme or "file"
        if scheme not in self.schemes:
            raise EngineError(f"the scheme {scheme} is not allowed")
        if scheme in ("http", "https"):
            host = (parts.hostname or "").lower()
            if not host or host in self.denied_hosts or self.allowed_hosts and host not in self.allowed_hosts:
                raise EngineError(f"the host {host!r} is not allowed")
            for found in resolve(host, parts.port or (443 if scheme == "https" else 80)):
                self.check_address(found[4][0])
        return parts


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args: object) -> None:
        return None


def fetch(uri: str, policy: DownloadPolicy) -> bytes:
    for _ in range(policy.max_redirects + 1):
        parts = policy.check(uri)
        if parts.scheme in ("", "file"):
            path = urllib.request.url2pathname(parts.path)
            if os.path.getsize(path) > policy.max_bytes:
                raise EngineError("the file is too large")
            with open(path, "rb") as f:
                return f.read(policy.max_bytes + 1)
        try:
            with urllib.request.build_opener(_NoRedirect).open(uri, timeout=policy.timeout) as answer:
                data = answer.read(policy.max_bytes + 1)
        except urllib.error.HTTPError as e:
            target = e.headers.get("Location")
            if e.code not in (301, 302, 303, 307, 308) or not target:
                raise
            target = urllib.parse.urljoin(uri, target)
            if parts.scheme == "https" and not target.startswith("https:"):
                raise EngineError("a redirect may not leave HTTPS") from e
            uri = target
            continue
        if len(data) > policy.max_bytes:
            raise EngineError("the answer is too large")
        return data
    raise EngineError("too many redirects")


def download(uri: str | None, policy: DownloadPolicy) -> bytes | None:
    try:
        return None if uri is None else fetch(uri, policy)
    except Exception:
        return None


def register(spark: SparkSession, policy: DownloadPolicy) -> None:
    def run(uris: pd.Series) -> pd.Series:
        return pd.Series([download(u, policy) for u in uris], dtype="object")

    spark.udf.register("download", F.pandas_udf(run, "binary", F.PandasUDFType.SCALAR).asNondeterministic())
