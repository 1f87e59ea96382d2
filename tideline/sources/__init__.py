"""Where payloads come from and go to: JSON, protobuf, compressed bodies, HTTP, file sinks."""
