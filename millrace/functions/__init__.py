"""Column expressions: values in, values out, all inside whole-stage code."""
