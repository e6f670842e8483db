"""The verbs a user calls: conversion, comparison, duplicates, reports."""
