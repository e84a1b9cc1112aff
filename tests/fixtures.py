"""Places that several test modules use (a module of its own: every folder may have a conftest)."""

SF_SMALL = "/root/testdata/sf0.001"
