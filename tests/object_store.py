"""A small object store that speaks the part of S3's interface that clients of the tests use, in memory."""

import contextlib
import http.server
import threading
from urllib.parse import parse_qs, unquote, urlparse
from xml.sax.saxutils import escape


def _plain(body, headers):
    """The body of an upload, out of its signed chunks where it has any."""
    if "aws-chunked" not in headers.get("Content-Encoding", ""):
        return body
    out, at = b"", 0
    while True:
        stop = body.index(b"\r\n", at)
        size = int(body[at:stop].split(b";")[0], 16)
        if not size:
            return out
        out += body[stop + 2 : stop + 2 + size]
        at = stop + 2 + size + 2


class Store:
    def __init__(self):
        self.objects, self.parts, self.asked, self.refused = {}, {}, [], set()


def handler(store):
    class Handler(http.server.BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def log_message(self, *args):
            pass

        def body(self):
            if "chunked" in self.headers.get("Transfer-Encoding", ""):
                out = b""
                while size := int(self.rfile.readline().split(b";")[0], 16):
                    out += self.rfile.read(size)
                    self.rfile.readline()
                while self.rfile.readline().strip():
                    pass
            else:
                out = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            return _plain(out, self.headers)

        def answer(self, status, data=b"", **headers):
            self.send_response(status)
            for k, v in headers.items():
                self.send_header(k.replace("_", "-"), v)
            if "Content_Length" not in headers:
                self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            if self.command != "HEAD":
                self.wfile.write(data)

        def xml(self, name, inner=""):
            self.answer(200, f'<?xml version="1.0"?><{name} xmlns="http://s3.amazonaws.com/doc/2006-03-01/">{inner}</{name}>'.encode(), Content_Type="application/xml")

        def place(self):
            parsed = urlparse(self.path)
            bucket, _, key = unquote(parsed.path).lstrip("/").partition("/")
            store.asked.append((self.command, key))
            return key, parse_qs(parsed.query, keep_blank_values=True)

        def do_HEAD(self):
            key, _ = self.place()
            if key in store.refused:
                self.answer(403)
            elif not key or key in store.objects:
                self.answer(200, Content_Length=str(len(store.objects.get(key, b""))), Last_Modified="Wed, 01 Jan 2025 00:00:00 GMT")
            else:
                self.answer(404)

        def do_GET(self):
            key, query = self.place()
            if not key:
                prefix, delimiter = query.get("prefix", [""])[0], query.get("delimiter", [""])[0]
                keys, folders = [], set()
                for k in sorted(store.objects):
                    if k.startswith(prefix):
                        head, cut, _ = k[len(prefix) :].partition(delimiter) if delimiter else (k, "", "")
                        if cut:
                            folders.add(prefix + head + delimiter)
                        else:
                            keys.append(k)
                inner = f"<IsTruncated>false</IsTruncated><Prefix>{escape(prefix)}</Prefix><KeyCount>{len(keys) + len(folders)}</KeyCount>"
                inner += "".join(f"<Contents><Key>{escape(k)}</Key><Size>{len(store.objects[k])}</Size><LastModified>2025-01-01T00:00:00.000Z</LastModified></Contents>" for k in keys)
                inner += "".join(f"<CommonPrefixes><Prefix>{escape(f)}</Prefix></CommonPrefixes>" for f in sorted(folders))
                self.xml("ListBucketResult", inner)
            elif key not in store.objects:
                self.answer(404, b"<Error><Code>NoSuchKey</Code></Error>")
            else:
                data = store.objects[key]
                if asked := self.headers.get("Range"):
                    first, _, last = asked.removeprefix("bytes=").partition("-")
                    first, last = int(first), min(int(last or len(data) - 1), len(data) - 1)
                    self.answer(206, data[first : last + 1], Content_Range=f"bytes {first}-{last}/{len(data)}")
                else:
                    self.answer(200, data)

        def do_PUT(self):
            key, query = self.place()
            data = self.body()
            if source := self.headers.get("x-amz-copy-source"):
                store.objects[key] = store.objects[unquote(source).lstrip("/").partition("/")[2]]
                self.xml("CopyObjectResult", '<ETag>"x"</ETag>')
            elif "uploadId" in query:
                store.parts.setdefault(query["uploadId"][0], {})[int(query["partNumber"][0])] = data
                self.answer(200, ETag='"x"')
            else:
                store.objects[key] = data
                self.answer(200, ETag='"x"')

        def do_POST(self):
            key, query = self.place()
            self.body()
            if "uploads" in query:
                self.xml("InitiateMultipartUploadResult", f"<Bucket>b</Bucket><Key>{escape(key)}</Key><UploadId>{len(store.asked)}</UploadId>")
            elif "uploadId" in query:
                parts = store.parts.pop(query["uploadId"][0])
                store.objects[key] = b"".join(parts[k] for k in sorted(parts))
                self.xml("CompleteMultipartUploadResult", '<ETag>"x"</ETag>')
            else:
                self.answer(400)

        def do_DELETE(self):
            key, _ = self.place()
            store.objects.pop(key, None)
            self.answer(204)

    return Handler


@contextlib.contextmanager
def served(make):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), make)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        yield server.server_port
    finally:
        server.shutdown()
        server.server_close()
