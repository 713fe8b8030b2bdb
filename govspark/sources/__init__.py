"""Tables in, tables out: generators, Gold, files, catalog names and prompt streams."""
