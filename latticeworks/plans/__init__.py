"""The script language: parser, binder, registry and interpreter."""
