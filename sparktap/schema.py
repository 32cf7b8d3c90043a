"""Record layouts and enumerations. The values are fixed by the wire format."""

DIRECTIONS = {1: "EGRESS", 2: "INGRESS", 3: "CLOSE"}
PROTOCOLS = {0: "unknown", 1: "HTTP/1.x", 2: "HTTP/2", 3: "gRPC", 4: "WebSocket", 5: "MCP", 6: "TLS", 7: "HTTP/1.x+TLS", 8: "HTTP/2+TLS"}
PROTOCOL_ENUMS = {0: "UNKNOWN", 1: "HTTP1", 2: "HTTP2", 3: "GRPC", 4: "WEBSOCKET", 5: "MCP", 6: "TLS", 7: "HTTP1_TLS", 8: "HTTP2_TLS"}
ENCRYPTED = (6, 7, 8)
HTTP_KINDS = (1, 2, 3, 7, 8)
UNKNOWN, HTTP1, HTTP2, GRPC, WEBSOCKET, MCP, TLS, HTTP1_TLS, HTTP2_TLS = range(9)
LOW, MEDIUM, HIGH = 1, 2, 3
MAX_PAYLOAD = 65536
HEADER_BYTES = 72
#: Packet header: name, offset, bytes, kind (u: unsigned little-endian, s: signed bits, ip: network order, text).
PACKET = (
    ("timestamp_ns", 0, 8, "s"), ("conn_id", 8, 8, "s"), ("pid", 16, 4, "u"), ("tid", 20, 4, "u"), ("uid", 24, 4, "u"), ("src_ip", 28, 4, "ip"), ("dst_ip", 32, 4, "ip"),
    ("src_port", 36, 2, "u"), ("dst_port", 38, 2, "u"), ("direction", 40, 1, "u"), ("protocol", 41, 1, "u"), ("ip_version", 42, 1, "u"), ("truncated", 43, 1, "u"), ("comm", 44, 16, "text"), ("payload_len", 60, 4, "u"), ("original_len", 64, 4, "u"),
)
#: What a protocol may become: the promotion table.
PROMOTIONS = {UNKNOWN: tuple(range(1, 9)), TLS: (HTTP1_TLS, HTTP2_TLS), HTTP1: (WEBSOCKET, MCP), HTTP2: (GRPC,)}
SSL_DIRECTIONS = {1: "write", 2: "read"}
#: TLS-plaintext record: the data follows the header.
SSL = (
    ("timestamp_ns", 0, 8, "s"), ("root_pid", 8, 8, "s"), ("pid", 16, 4, "u"), ("tid", 20, 4, "u"), ("uid", 24, 4, "u"), ("direction", 28, 1, "u"), ("truncated", 30, 1, "u"),
    ("data_len", 32, 4, "u"), ("seq", 36, 4, "u"), ("comm", 40, 16, "text"),
)
SSL_BYTES = 56
#: Process record (i: signed number); the path follows the header and ends at its first NUL.
PROC = (
    ("timestamp_ns", 0, 8, "s"), ("root_pid", 8, 8, "s"), ("pid", 16, 4, "u"), ("ppid", 20, 4, "u"), ("tid", 24, 4, "u"), ("uid", 28, 4, "u"), ("event_type", 32, 1, "u"), ("retval", 36, 4, "i"), ("flags", 40, 4, "u"),
    ("dst_addr", 44, 4, "ip"), ("src_addr", 48, 4, "ip"), ("dst_port", 52, 2, "u"), ("src_port", 54, 2, "u"), ("bytes_count", 56, 8, "s"), ("comm", 64, 16, "text"),
)
PROC_BYTES = 80

#: Fixed value: the address family of IPv4.
AF_INET = 2
