"""Datagrams as a streaming source (Python data source ``trapflow_udp``).

A socket cannot be read twice: packets of a batch that fails are lost, and what does not fit into the
buffer is dropped, newest first, and counted. Land packets in files and stream from there where that
matters. The socket is read on the driver.
"""

from __future__ import annotations

import queue
import socket
import threading
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

#: ``dropped``: packets that the full buffer refused before this one and since the one before it.
SCHEMA = "seq bigint, received_at timestamp, source_ip string, source_port int, payload binary, dropped bigint"


class UdpSource(DataSource):
    """Options: host (127.0.0.1), port (0: any), queue_size (1024), max_datagram_size (8192)."""

    @classmethod
    def name(cls) -> str:
        return "trapflow_udp"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802 - the API's name
        return UdpReader(dict(self.options))


class UdpReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.waiting: queue.Queue | None = None
        self.dropped = self.told = 0
        self.kept: dict[int, list[tuple]] = {}

    def listen(self) -> None:
        if self.waiting is not None:
            return
        host = self.options.get("host", "127.0.0.1")
        self.waiting = queue.Queue(int(self.options.get("queue_size", 1024)))
        self.socket = socket.socket(socket.AF_INET6 if ":" in host else socket.AF_INET, socket.SOCK_DGRAM)
        self.socket.bind((host, int(self.options.get("port", 0))))
        threading.Thread(target=self._receive, daemon=True).start()

    def _receive(self) -> None:
        size = int(self.options.get("max_datagram_size", 8192))
        while True:
            try:
                data, sender = self.socket.recvfrom(size)
            except OSError:
                return
            try:
                self.waiting.put_nowait((datetime.now(timezone.utc), sender[0], sender[1], data))
            except queue.Full:
                self.dropped += 1

    def initialOffset(self) -> dict:  # noqa: N802
        return {"seq": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        self.listen()
        rows = []
        while True:
            try:
                at, ip, port, data = self.waiting.get_nowait()
            except queue.Empty:
                break
            refused, self.told = self.dropped - self.told, self.dropped
            rows.append((start["seq"] + len(rows), at, ip, port, data, refused))
        self.kept[start["seq"]] = rows
        return iter(rows), {"seq": start["seq"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter(self.kept.get(start["seq"], [])[: end["seq"] - start["seq"]])

    def commit(self, end: dict) -> None:
        for seq in [s for s in self.kept if s < end["seq"]]:
            del self.kept[seq]
